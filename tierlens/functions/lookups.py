"""Column lookups into the fixed dimensions.

A four-row dimension is folded into a literal map, so the lookup is a
projection inside whole-stage codegen rather than a join.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tierlens import dims


def _map(pairs) -> Column:
    flat = []
    for k, v in pairs:
        flat += [F.lit(k), F.lit(v)]
    return F.create_map(*flat)


def tier_label(tier: Column) -> Column:
    """Label of a tier, NULL when the tier is unknown."""
    return _map((t, lab) for t, lab, _ in dims.TIERS)[tier]


def tier_model(tier: Column) -> Column:
    """Model of a tier, NULL when the tier is unknown."""
    return _map((t, m) for t, _, m in dims.TIERS)[tier]


def model_tier(model: Column) -> Column:
    """Inverse lookup model -> tier; unknown (e.g. the summariser) -> NULL."""
    return _map((m, t) for t, _, m in dims.TIERS)[model].cast("int")


def price_in(book: str, tier: Column) -> Column:
    rates = dims.PRICE_BOOKS[book]
    return _map((t, dims.nano_per_token(i)) for t, (i, _) in rates.items())[tier].cast("bigint")


def price_out(book: str, tier: Column) -> Column:
    rates = dims.PRICE_BOOKS[book]
    return _map((t, dims.nano_per_token(o)) for t, (_, o) in rates.items())[tier].cast("bigint")


def cost_nano(book: str, tier: Column, input_tokens: Column, output_tokens: Column) -> Column:
    """Cost of one call in nano-USD; NULL when the tier has no price."""
    return input_tokens.cast("bigint") * price_in(book, tier) + output_tokens.cast("bigint") * price_out(book, tier)
