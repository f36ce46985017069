"""Routing-decision operators: B1-B5 (parse, clamp, enrich, strict parse, service fallback)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlens import dims
from tierlens.functions import parsing as P
from tierlens.functions.lookups import tier_label, tier_model


def tolerant_parse(df: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Adds ``parse_path``, ``raw_tier``, ``raw_confidence`` (before clamping)."""
    return df.withColumn("_p", P.tolerant_extract(F.col(raw_col))).select("*", "_p.*").drop("_p")


def clamp(df: DataFrame, tier_col: str = "raw_tier", conf_col: str = "raw_confidence") -> DataFrame:
    """B2: ``model_tier`` in 1..4 (int truncation) and ``confidence`` in 0..1."""
    return (df.withColumn("model_tier", P.clamp_tier(F.col(tier_col)))
              .withColumn("confidence", P.clamp_confidence(F.col(conf_col))))


def enrich(df: DataFrame, tier_col: str = "model_tier") -> DataFrame:
    """B1: tier label and model, defaulting to ``medium`` / the small model."""
    t = F.col(tier_col)
    return (df.withColumn("tier_label", F.coalesce(tier_label(t), F.lit(dims.DEFAULT_TIER_LABEL)))
              .withColumn("model_name", F.coalesce(tier_model(t), F.lit(dims.DEFAULT_TIER_MODEL))))


def route_decisions(df: DataFrame, raw_col: str = "raw") -> DataFrame:
    """B3 -> B2 -> B1 in one projection."""
    return enrich(clamp(tolerant_parse(df, raw_col)))


def strict_parse(df: DataFrame, raw_col: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Strict extraction. Returns (accepted, rejected).

    Accepted rows carry ``model_tier`` (default 1, not clamped), ``confidence``
    and ``model_name`` (an unknown tier maps to the router's default model).
    Rows whose text holds no JSON object are quarantined instead of raising.
    """
    parsed = df.withColumn("_obj", P.strict_object(F.col(raw_col)))
    ok = parsed.filter(F.col("_obj").isNotNull())
    tier = F.coalesce(F.try_variant_get("_obj", "$.model_tier", "bigint"), F.lit(1).cast("bigint"))
    ok = (ok.withColumn("model_tier", tier)
            .withColumn("confidence", F.try_variant_get("_obj", "$.confidence", "double"))
            .withColumn("model_name", F.coalesce(tier_model(F.col("model_tier").cast("int")),
                                                 F.lit(dims.ROUTER_DEFAULT_MODEL)))
            .drop("_obj"))
    bad = (parsed.filter(F.col("_obj").isNull()).drop("_obj")
                 .withColumn("reject_reason", F.lit("no_json_object")))
    return ok, bad


def service_fallback(df: DataFrame, raw_col: str = "raw", error_col: str = "call_error") -> DataFrame:
    """A failed classifier call routes to (2, 0.0); a call without a
    generated text (malformed body) to (2, 0.3); otherwise B3 on the trimmed text.
    Then clamp and enrich."""
    parsed = tolerant_parse(df.withColumn("_txt", F.trim(F.col(raw_col))), "_txt").drop("_txt")
    err = F.col(error_col).isNotNull()
    malformed = F.col(raw_col).isNull()
    out = (parsed
           .withColumn("parse_path", F.when(err, "service_error").when(malformed, "malformed_body")
                       .otherwise(F.col("parse_path")))
           .withColumn("raw_tier", F.when(err, float(P.SERVICE_ERROR[0])).when(malformed, float(P.MALFORMED_BODY[0]))
                       .otherwise(F.col("raw_tier")))
           .withColumn("raw_confidence", F.when(err, P.SERVICE_ERROR[1]).when(malformed, P.MALFORMED_BODY[1])
                       .otherwise(F.col("raw_confidence"))))
    return enrich(clamp(out))
