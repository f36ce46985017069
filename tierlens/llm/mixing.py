"""Mixing sources to target weights by hierarchical budgeting.

The tree has three levels: domain, language, source. A token budget goes down
the tree by the weights of the children. A child takes no more than its
subtree can give (tokens times epochs); what it cannot take goes to its
siblings by their weights, and only if all siblings are full does the parent
pass less, so shortages reach siblings before ancestors. One level is solved
in closed form: with capacities c and weights w in the order of c/w, the level
``max((B - sum of c before) / (sum of w from here on))`` is the water level L,
and every child takes ``min(c, floor(L * w))`` whole tokens.

Each leaf then takes whole epochs of its documents and, of the epoch after
those, the longest prefix in seeded order whose tokens fit the rest. Prefix
sums run in two steps: sums per hash range of the leaf first, then row by row
only in the one range that the budget ends in, so a leaf that holds a third of
all rows is never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierlens.llm.tables import save

LEVELS = ("domain", "lang", "source")
#: Hash ranges of a leaf's seeded order: the first hex digits of an MD5.
RANGE_DIGITS = 3


def words(col: str = "text") -> Column:
    """Tokens of a text: words ``[^\\x20\\x09-\\x0D]+``."""
    return F.coalesce(F.regexp_count(F.col(col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _level(nodes: DataFrame, parents: list[str], weight: str) -> DataFrame:
    """Split each parent's ``given`` among its children (``cap``, ``weight``)."""
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("cap") / F.col(weight), *LEVELS[:len(parents) + 1])
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(weight).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    at = nodes.withColumn("level", (F.col("given") - before).cast("double") / rest.cast("double"))
    at = at.withColumn("level", F.greatest(F.max("level").over(by), F.lit(0.0)))
    share = F.floor(F.col("level") * F.col(weight).cast("double"))
    return at.withColumn("given", F.least(F.col("cap"), share.cast("bigint"))).drop("level")


def budgets(leaves: DataFrame, total: Column, epochs: int) -> DataFrame:
    """Leaf budgets. ``leaves``: domain, lang, source, ``have`` (tokens) and
    the positive whole weights ``w_domain, w_lang, w_source`` of each level."""
    leaves = leaves.withColumn("cap", F.col("have") * epochs)
    given = leaves.agg(total.cast("bigint").alias("given"))
    plan = None
    for depth in range(1, 4):
        keys = list(LEVELS[:depth])
        weight = f"w_{LEVELS[depth - 1]}"
        nodes = leaves.groupBy(*keys).agg(F.sum("cap").alias("cap"), F.max(weight).alias(weight))
        if plan is None:
            nodes = nodes.withColumn("given", given.scalar())
        else:
            nodes = nodes.join(plan.select(*keys[:-1], "given"), keys[:-1])
        plan = _level(nodes, keys[:-1], weight)
    return plan.select(*LEVELS, F.col("given").alias("budget"))


def mix_sources(docs: DataFrame, weights: dict[str, Column], share: float, epochs: int = 1, seed: int = 0,
                tokens: Column | None = None) -> DataFrame:
    """Rows ``doc_id, domain, lang, source, n_tokens, epoch``: every document
    chosen, once per epoch (from 0) it is used in.

    ``docs`` has ``doc_id, domain, lang, source, text``; ``weights`` gives the
    positive whole weight of a node at each level as a column of the level
    names; the budget is ``share`` of all tokens; a document is used at most
    ``epochs`` times. Missing domain, language or source count as ``""``.
    Documents without tokens fit any budget: they are in the prefix up to which
    the order has come. Documents with equal ids are ordered by their tokens.
    Null ids order as the text ``null``. Extra columns are ignored; an empty
    table gives an empty result.
    """
    tokens = words() if tokens is None else tokens
    light = save(docs.select("doc_id", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in LEVELS],
                             tokens.alias("n_tokens")), "tokens")
    leaves = light.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("have"))
    for c in LEVELS:
        leaves = leaves.withColumn(f"w_{c}", weights[c].cast("bigint"))
    plan = budgets(leaves, F.floor(F.sum("have") * share), epochs).join(leaves.select(*LEVELS, "have"), list(LEVELS))
    plan = save(plan.withColumn("full", F.when(F.col("have") > 0, F.least(F.floor(F.col("budget") / F.col("have")), F.lit(epochs))).otherwise(1))
                .withColumn("rest", F.col("budget") - F.col("full") * F.col("have")), "budgets")

    keyed = light.join(plan.select(*LEVELS, "full", "rest"), list(LEVELS)).withColumn(
        "place", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    keyed = keyed.withColumn("range", F.substring("place", 1, RANGE_DIGITS))
    part = Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = keyed.groupBy(*LEVELS, "range").agg(F.sum("n_tokens").alias("here")).withColumn(
        "before", F.coalesce(F.sum("here").over(part), F.lit(0)))
    keyed = keyed.join(ranges, [*LEVELS, "range"])
    whole = F.col("before") + F.col("here") <= F.col("rest")
    inside = keyed.filter(~whole & (F.col("before") <= F.col("rest")))
    row = Window.partitionBy(*LEVELS, "range").orderBy("place", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("fits", F.col("before") + F.sum("n_tokens").over(row) <= F.col("rest"))
    decided = inside.unionByName(keyed.filter(whole | (F.col("before") > F.col("rest"))).withColumn("fits", whole))
    used = decided.withColumn("used", F.least(F.col("full") + F.col("fits").cast("bigint"), F.lit(epochs).cast("bigint"))).filter("used > 0")
    return used.select("doc_id", *LEVELS, "n_tokens",
                       F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("used") - 1)).alias("epoch"))


#: The tree of the test tables: three domains, four languages, equal sources.
DOMAIN_NAMES = ("web", "reference", "forum")
DOMAIN_WEIGHTS = {"web": 50, "reference": 30, "forum": 20}
LANGUAGE_WEIGHTS = {"en": 50, "de": 20, "fr": 20, "es": 10}


def with_domain(docs: DataFrame) -> DataFrame:
    """Stand-in for a domain column: sources are dealt to the domains by their number."""
    number = F.coalesce(F.regexp_extract("source", "([0-9]+)", 1).try_cast("bigint"), F.lit(0))
    names = F.array(*[F.lit(n) for n in DOMAIN_NAMES])
    return docs.withColumn("domain", F.element_at(names, (number % len(DOMAIN_NAMES) + 1).cast("int")))


def table_weights() -> dict[str, Column]:
    """Whole weights of the test tables' tree; an unknown language weighs 1."""
    def of(col: str, table: dict[str, int]) -> Column:
        out = F.lit(1)
        for k, v in table.items():
            out = F.when(F.col(col) == k, v).otherwise(out)
        return out

    return {"domain": of("domain", DOMAIN_WEIGHTS), "lang": of("lang", LANGUAGE_WEIGHTS), "source": F.lit(1)}
