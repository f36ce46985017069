"""Column expressions for tolerant / strict extraction of classifier output.

All steps are JVM-side expressions (regex + variant parsing); no Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- FIXED VALUES: extraction patterns of the routing classifier ----------
EMBEDDED_OBJECT = r"\{[^}]+\}"
GREEDY_OBJECT = r"(?s)\{.*\}"
TIER_KEYWORD = r"""(?:model_tier|tier|Tier|category|level)["\s\-_:]+(\d)"""
CONFIDENCE_KEYWORD = r"""(?:confidence|Confidence|score|probability)["\s\-_:]+(0?\.\d+)"""
DEFAULT_TIER = 2
DEFAULT_CONFIDENCE = 0.5
FALLBACK = (2, 0.3)          # nothing parsable
SERVICE_ERROR = (2, 0.0)     # the classifier call failed
MALFORMED_BODY = (2, 0.3)    # the call returned an unexpected body
# ---- end of fixed values ---------------------------------------------------


def json_object(text: Column) -> Column:
    """Parse ``text`` as one whole JSON object, else NULL.

    ``try_parse_json`` tolerates trailing text after the first value, so the
    trimmed text must also start with ``{`` and end with ``}``; scalars and
    arrays are not objects and give NULL.
    """
    v = F.try_parse_json(text)
    is_obj = F.trim(text).rlike(r"(?s)^\{.*\}$") & F.schema_of_variant(v).startswith("OBJECT")
    return F.when(is_obj, v)


def _num(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "double")


def tolerant_extract(raw: Column) -> Column:
    """struct(parse_path, raw_tier double, raw_confidence double).

    whole JSON object -> first ``{...}`` without nested braces -> tier keyword
    (confidence keyword or 0.5) -> fallback (2, 0.3). Missing keys in an
    object default to tier 2 / confidence 0.5.
    """
    whole = json_object(raw)
    emb_txt = F.regexp_extract(raw, EMBEDDED_OBJECT, 0)
    emb = F.when(emb_txt != "", json_object(emb_txt))
    kw_tier = F.regexp_extract(raw, TIER_KEYWORD, 1)
    kw_conf = F.regexp_extract(raw, CONFIDENCE_KEYWORD, 1)

    def from_obj(v):
        return (F.coalesce(_num(v, "model_tier"), F.lit(float(DEFAULT_TIER))),
                F.coalesce(_num(v, "confidence"), F.lit(DEFAULT_CONFIDENCE)))

    wt, wc = from_obj(whole)
    et, ec = from_obj(emb)
    path = (F.when(whole.isNotNull(), "json").when(emb.isNotNull(), "embedded_json")
             .when(kw_tier != "", "keyword").otherwise("fallback"))
    tier = (F.when(whole.isNotNull(), wt).when(emb.isNotNull(), et)
             .when(kw_tier != "", kw_tier.cast("double")).otherwise(F.lit(float(FALLBACK[0]))))
    conf = (F.when(whole.isNotNull(), wc).when(emb.isNotNull(), ec)
             .when(kw_tier != "", F.coalesce(F.when(kw_conf != "", kw_conf.cast("double")), F.lit(DEFAULT_CONFIDENCE)))
             .otherwise(F.lit(FALLBACK[1])))
    return F.struct(path.alias("parse_path"), tier.alias("raw_tier"), conf.alias("raw_confidence"))


def clamp_tier(raw_tier: Column) -> Column:
    """B2: integer truncation, then clamp to 1..4."""
    return F.greatest(F.lit(1), F.least(F.lit(4), raw_tier.cast("int")))


def clamp_confidence(raw_conf: Column) -> Column:
    """B2: clamp to 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw_conf.cast("double")))


def strict_object(raw: Column) -> Column:
    """Greedy first-``{`` to last-``}`` span (dot matches newlines) parsed
    as JSON, or the whole text when there is no brace; NULL unless an object."""
    span = F.regexp_extract(raw, GREEDY_OBJECT, 0)
    return F.when(span != "", json_object(span)).otherwise(json_object(raw))
