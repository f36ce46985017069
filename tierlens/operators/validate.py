"""Chat-example validator -- the first failing rule per line, all JVM-side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlens.functions.parsing import json_object

# ---- FIXED VALUES: rule order of the example validator --------------------
RULES = [
    "invalid_json",         # the line is not JSON
    "missing_messages",     # no ``messages`` key
    "too_few_messages",     # fewer than 2 messages
    "last_not_assistant",   # last message is not from the assistant
    "content_not_json",     # assistant content not a JSON object (or confidence null)
    "invalid_tier",         # model_tier not in 1..4
    "invalid_confidence",   # confidence outside 0..1
]
# ---- end of fixed values ---------------------------------------------------


def validate_examples(df: DataFrame, line_col: str = "line") -> DataFrame:
    """Adds ``error_code`` (NULL when valid) and ``tier``."""
    line = F.col(line_col)
    # Staged projections: each parsed value is computed once and referenced
    # by name, which keeps the generated code small.
    df = df.withColumn("_v", F.try_parse_json(line))
    v = F.col("_v")
    # try_parse_json ignores text after the first value: an object must also
    # span the whole trimmed line.
    df = (df.withColumn("_valid", v.isNotNull() & (F.trim(line).rlike(r"(?s)^\{.*\}$")
                                                 == F.schema_of_variant(v).startswith("OBJECT")))
            .withColumn("_has", F.try_variant_get(v, "$.messages", "variant").isNotNull())
            .withColumn("_msgs", F.try_variant_get(v, "$.messages", "array<variant>")))
    df = (df.withColumn("_n", F.size("_msgs"))
            .withColumn("_role", F.try_variant_get(F.element_at("_msgs", -1), "$.role", "string"))
            .withColumn("_content", F.try_variant_get(F.element_at("_msgs", -1), "$.content", "string")))
    df = df.withColumn("_out", json_object(F.col("_content")))
    df = (df.withColumn("_tier", F.try_variant_get("_out", "$.model_tier", "double"))
            .withColumn("_conf", F.try_variant_get("_out", "$.confidence", "double")))
    tier, conf = F.col("_tier"), F.col("_conf")
    code = (F.when(~F.col("_valid"), RULES[0])
             .when(~F.col("_has"), RULES[1])
             .when(F.col("_n") < 2, RULES[2])
             .when(~F.coalesce(F.col("_role") == "assistant", F.lit(False)), RULES[3])
             .when(F.col("_out").isNull(), RULES[4])
             .when(tier.isNull() | ~tier.isin(1.0, 2.0, 3.0, 4.0), RULES[5])
             .when(conf.isNull(), RULES[4])
             .when((conf < 0) | (conf > 1), RULES[6]))
    df = df.withColumn("error_code", code)
    return (df.withColumn("tier", F.when(F.col("error_code").isNull(), tier.cast("int")))
              .drop("_v", "_valid", "_has", "_msgs", "_n", "_role", "_content", "_out", "_tier", "_conf"))
