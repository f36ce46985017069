"""Personal data by candidate gradient boosting, with DataFrame functions only.

**Base spans.** Four patterns (email, ip, card, phone), leftmost and
non-overlapping per kind, each with its check. They always stay.

**Candidates.** Generators of high recall propose overlapping spans: addresses
with the at sign written out or spaced, digit groups with loose separators or
without blanks, and dotted numbers with the dots written out. Each has small
whole-number features of format and context; the marks that the base patterns
hang on (the at sign, the leading plus, the separators of a card) are not among
them.

**Boosted trees.** What is written plainly teaches what its disguises look like:
every base span of the corpus is rewritten once in its context, marks written
out, dropped or exchanged (a positive example), and damaged once, a digit changed,
a part out of range, digits cut off (a negative one). Candidates of the corpus
that lie in no base span are negatives too. Training rows are grouped by feature vector
first, so all of them count and the driver gets one row per vector (their number
is bounded by the features' ranges, not by the input). Trees of depth two are
fitted to the logistic loss on one half of the documents; on the other half a
threshold per kind is calibrated as the lowest score from which on at least
``PRECISION`` of the examples are positive (a disguise that is already in the
corpus counts as a negative there, so the true precision is higher). The trees become a column expression;
candidates that pass and lie in no base span are added.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierlens.llm.tables import keyed, save, shown

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

# The four base patterns, written so that each finds the same matches in time
# linear in the text: possessive repeats where nothing can be given back, a
# start only where a run begins or the last match ended, and for cards only
# runs of enough digits to pass the check.
_BASE = {
    EMAIL: r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    IP: r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    CARD: r"[0-9](?:[ -]?[0-9]){13,}+",
    PHONE: r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without this character has no match of the kind.
_NEEDS = {EMAIL: "@", IP: ".", PHONE: "+"}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

_AT = r" ?(?:@|\[at\]|\(at\)|\{at\}| at ) ?"
_DOT = r"(?: ?\[dot\] ?| ?\(dot\) ?| dot |\[\.\]|\.)"
_GENERATORS = {
    0: rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++",
    1: r"(?<![0-9A-Za-z])\(?[0-9](?:[ ().\-/]{0,3}[0-9]){6,}+",
    2: r"(?<![0-9A-Za-z])[0-9](?:[.\-/]?[0-9]){6,}+",
    3: rf"(?<![0-9A-Za-z])[0-9]++(?: ?{_DOT} ?[0-9]++){{3}}+",
}
_CONTEXT = r"(?i)\b(?:e-?mail|mail|phone|tel|telephone|call|fax|contact|card|visa|credit|ip|host|server)\b"

#: Largest value of each feature; the product bounds the number of training rows.
FEATURES = {"gen": 3, "check": 1, "digits": 5, "seps": 3, "dots": 4, "size": 4, "context": 1, "after": 2, "paren": 1, "group": 3}
ROUNDS, RATE, PRECISION, LEAST = 30, 0.3, 0.9, 20


#: Matches numbered together; a text's matches are numbered in time linear in them.
_BLOCK = 256


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _matches(text: Column, pattern: str, context: bool = False) -> Column:
    """Every match as (s, e, v[, left, right]), code points, end exclusive: the
    pieces between matches give the positions, summed in two levels (inside
    blocks of matches, then over blocks)."""
    fields = "s:int,e:int,v:string" + (",left:string,right:string" if context else "")

    def pieces(gaps: Column) -> Column:
        def one(h: Column, i: Column) -> Column:
            got = [F.char_length(F.get(gaps, i)).alias("gap"), h.alias("v")]
            if context:
                got += [F.right(F.get(gaps, i), F.lit(24)).alias("left"), F.left(F.get(gaps, i + 1), F.lit(1)).alias("right")]
            return F.struct(*got)
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), one)

    def add(acc: Column, m: Column) -> Column:
        start = acc.pos + m.gap
        end = start + F.char_length(m.v)
        got = [start.alias("s"), end.alias("e"), m.v.alias("v")] + ([m.left.alias("left"), m.right.alias("right")] if context else [])
        return F.struct(end.alias("pos"), F.concat(acc.out, F.array(F.struct(*got))).alias("out"))

    zero = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<struct<{fields}>>").alias("out"))

    def blocks(all_: Column) -> Column:
        last = F.greatest(F.ceil(F.size(all_) / _BLOCK).cast("int"), F.lit(1)) - 1
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.aggregate(F.slice(all_, b * _BLOCK + 1, F.lit(_BLOCK)), zero, add))

    def placed(done: Column) -> Column:
        starts = F.aggregate(done, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b.pos)))
        return _let(starts, lambda at: F.flatten(F.transform(done, lambda b, i: F.transform(b.out, lambda m: m.withField(
            "s", m.s + F.get(at, i)).withField("e", m.e + F.get(at, i))))))

    return _let(_let(_let(F.split(text, pattern, -1), pieces), blocks), placed)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _valid(kind: int, v: Column) -> Column:
    if kind == EMAIL:
        return F.lit(True)
    if kind == IP:
        return F.regexp_like(v, F.lit(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"))
    n = F.length(_digits(v))
    if kind == CARD:
        return n.between(14, 19) & F.call_function("luhn_check", _digits(v))
    return n.between(10, 15)


def base_matches(text: Column) -> Column:
    """array<struct<s, k, e, v, left, right>> of the four base kinds, by start, then kind."""
    kind_of = "array<struct<s:int,k:int,e:int,v:string,left:string,right:string>>"

    def of(kind: int) -> Column:
        passed = F.filter(_matches(text, _BASE[kind], context=True), lambda m: _valid(kind, m.v))
        found = F.transform(passed, lambda m: F.struct(m.s.alias("s"), F.lit(kind).alias("k"), m.e.alias("e"), m.v.alias("v"),
                                                       m.left.alias("left"), m.right.alias("right"))).cast(kind_of)
        may = F.contains(text, F.lit(_NEEDS[kind])) if kind in _NEEDS else F.regexp_like(text, F.lit("[0-9][ -]?[0-9]"))
        return F.when(may, found).otherwise(F.array().cast(kind_of))

    return F.array_sort(F.concat(*[of(kind) for kind in _BASE]))


def _rewritten(kind: Column, v: Column, turn: Column) -> Column:
    """A base span in disguise; ``turn`` picks one of three."""
    def pick(*ways: Column) -> Column:
        return F.element_at(F.array(*ways), turn + 1)

    grouped = F.trim(F.regexp_replace(_digits(v), "(.{4})", "$1 "))
    plain = F.substr(v, F.lit(2))
    email = pick(F.replace(v, F.lit("@"), F.lit(" [at] ")), F.replace(v, F.lit("@"), F.lit(" at ")),
                 F.replace(F.replace(v, F.lit("@"), F.lit("(at)")), F.lit("."), F.lit(" [dot] ")))
    ip = pick(F.replace(v, F.lit("."), F.lit("[.]")), F.replace(v, F.lit("."), F.lit(" [dot] ")), F.replace(v, F.lit("."), F.lit(" dot ")))
    card = pick(F.replace(grouped, F.lit(" "), F.lit("/")), F.replace(grouped, F.lit(" "), F.lit(".")), F.replace(grouped, F.lit(" "), F.lit(" - ")))
    phone = pick(plain, F.concat(F.lit("00"), plain), F.replace(F.regexp_replace(plain, "[()]", ""), F.lit(" "), F.lit("/")))
    return F.when(kind == EMAIL, email).when(kind == IP, ip).when(kind == CARD, card).otherwise(phone)


def _damaged(kind: Column, v: Column) -> Column:
    """A base span that is none any more, in disguise too."""
    number = _digits(v)
    wrong = F.concat(F.left(number, F.length(number) - 1), ((F.right(number, F.lit(1)).cast("int") + 1) % 10).cast("string"))
    return (F.when(kind == EMAIL, F.regexp_replace(F.replace(v, F.lit("@"), F.lit(" at ")), r"\.", " ")).when(kind == IP, F.concat(F.lit("9"), F.replace(v, F.lit("."), F.lit(".9"))))
            .when(kind == CARD, F.trim(F.regexp_replace(wrong, "(.{4})", "$1 "))).otherwise(F.left(number, F.lit(8))))


def _step(value: Column, *bounds: int) -> Column:
    """How many of the rising bounds ``value`` has reached."""
    out = F.lit(0)
    for i, b in enumerate(bounds, 1):
        out = F.when(value >= b, i).otherwise(out)
    return out


def _candidate(gen: int, m: Column) -> Column:
    n = F.length(_digits(m.v))
    dots = F.length(m.v) - F.length(F.replace(m.v, F.lit("."), F.lit("")))
    four = F.regexp_replace(m.v, r"[^0-9]+", ".")
    quad = F.lit(True) if gen == 3 else F.regexp_like(m.v, F.lit(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"))
    kind = F.lit(EMAIL) if gen == 0 else F.when(quad, IP).when(n.between(14, 19), CARD).otherwise(PHONE)
    check = F.lit(0) if gen == 0 else (F.when(quad, _valid(IP, four)).otherwise(F.call_function("luhn_check", _digits(m.v)))).cast("int")
    seps = sum((F.contains(m.v, F.lit(c)).cast("int") for c in (" ", "-", "/")), F.lit(0))
    longest = F.array_max(F.transform(F.split(m.v, "[^0-9]+", -1), F.char_length))
    after = F.when(F.regexp_like(m.right, F.lit("[A-Za-z0-9]")), 1).when(F.regexp_like(m.right, F.lit(r"[^\s]")), 2).otherwise(0)
    values = {
        "gen": F.lit(gen), "check": check, "digits": _step(n, 1, 7, 10, 14, 20), "seps": seps, "dots": F.least(dots, F.lit(4)),
        "size": _step(F.char_length(m.v), 12, 16, 20, 30), "context": F.regexp_like(m.left, F.lit(_CONTEXT)).cast("int"),
        "after": after, "paren": F.contains(m.v, F.lit("(")).cast("int"), "group": _step(longest, 4, 5, 9)}
    return F.struct(m.s.alias("s"), kind.alias("k"), m.e.alias("e"), *[values[f].cast("int").alias(f) for f in FEATURES])


def candidate_spans(text: Column) -> Column:
    """array<struct<s, k, e, features ...>> of both generators."""
    kind = "array<struct<s:int,k:int,e:int," + ",".join(f"{f}:int" for f in FEATURES) + ">>"

    def of(gen: int) -> Column:
        matches = _matches(text, _GENERATORS[gen], context=True)
        if gen in (1, 2):  # no number of a person is longer than a card's
            matches = F.filter(matches, lambda m: F.length(_digits(m.v)) <= 19)
        found = F.transform(matches, lambda m: _candidate(gen, m)).cast(kind)
        may = F.regexp_like(text, F.lit("[0-9]")) if gen else F.regexp_like(text, F.lit(r"@|[\[({ ]at[\]) }]"))
        if gen == 3:
            may = F.regexp_like(text, F.lit(r"[0-9] ?[\[(. ]"))
        return F.when(may, found).otherwise(F.array().cast(kind))

    return F.concat(*[of(gen) for gen in _GENERATORS])


class Trees:
    """Boosted trees of depth two over whole-number features."""

    def __init__(self, x: np.ndarray, pos: np.ndarray, neg: np.ndarray):
        total = max(pos.sum() + neg.sum(), 1)
        rate = min(max(pos.sum() / total, 1e-6), 1 - 1e-6)
        self.start, self.trees = float(np.log(rate / (1 - rate))), []
        score = np.full(len(x), self.start)
        for _ in range(ROUNDS if len(x) else 0):
            p = 1 / (1 + np.exp(-score))
            grad, hess = pos - (pos + neg) * p, (pos + neg) * p * (1 - p)
            root = self._split(x, grad, hess, np.ones(len(x), bool))
            if root is None:
                break
            left = x[:, root[0]] <= root[1]
            sides = []
            for part in (left, ~left):
                cut = self._split(x, grad, hess, part)
                leaves = [part] if cut is None else [part & (x[:, cut[0]] <= cut[1]), part & (x[:, cut[0]] > cut[1])]
                values = [float(RATE * grad[m].sum() / (hess[m].sum() + 1.0)) for m in leaves]
                for m, v in zip(leaves, values):
                    score[m] += v
                sides.append((cut, values))
            self.trees.append((root, sides))

    @staticmethod
    def _split(x, grad, hess, rows):
        best, found = 1e-6, None
        g, h = grad[rows].sum(), hess[rows].sum()
        for f in range(x.shape[1]):
            for t in np.unique(x[rows, f])[:-1]:
                m = rows & (x[:, f] <= t)
                gl, hl = grad[m].sum(), hess[m].sum()
                gain = gl**2 / (hl + 1) + (g - gl)**2 / (h - hl + 1) - g**2 / (h + 1)
                if gain > best:
                    best, found = gain, (f, int(t))
        return found

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for root, sides in self.trees:
            left = x[:, root[0]] <= root[1]
            for part, (cut, values) in zip((left, ~left), sides):
                out[part] += values[0] if cut is None else np.where(x[part][:, cut[0]] <= cut[1], *values)
        return out

    def column(self, c: Column) -> Column:
        """The same score of a candidate struct, as a column."""
        names = list(FEATURES)

        def pick(cut, low, high):
            return F.when(c[names[cut[0]]] <= cut[1], low).otherwise(high)

        out = F.lit(self.start)
        for root, sides in self.trees:
            arms = [F.lit(v[0]) if cut is None else pick(cut, F.lit(v[0]), F.lit(v[1])) for cut, v in sides]
            out = out + pick(root, *arms)
        return out


#: Code points of a bin in which spans of one text are compared.
_BIN = 64


def loose_candidates(found: DataFrame) -> DataFrame:
    """(row, half, c) of every candidate that lies in no base span: spans of a
    text meet by bins of its positions, so a text of many spans is many small keys."""
    cands = found.select("row", "half", F.explode("cands").alias("c")).withColumn("bin", F.floor(F.col("c.s") / _BIN))
    bins = F.explode(F.sequence(F.floor(F.col("b.s") / _BIN), F.floor(F.col("b.e") / _BIN)))
    base = found.select(F.col("row").alias("r"), F.explode("base").alias("b")).select("r", F.col("b.s").alias("bs"), F.col("b.e").alias("be"), bins.alias("bbin"))
    inside = (F.col("row") == F.col("r")) & (F.col("bin") == F.col("bbin")) & (F.col("bs") <= F.col("c.s")) & (F.col("be") >= F.col("c.e"))
    return save(cands.join(base, inside, "left_anti").select("row", "half", "c"), "loose")


def examples(found: DataFrame, loose: DataFrame) -> DataFrame:
    """(half, c, good): one row per training example, a candidate and whether it is one of personal data."""
    outside = loose.select("half", "c", F.lit(False).alias("good"))
    known = found.select("half", F.explode("base").alias("b")).select("half", "b.*")
    turn = F.pmod(F.xxhash64("v"), F.lit(3)).cast("int")
    written = known.select("half", "k", "left", "right", F.explode(F.array(
        F.struct(_rewritten(F.col("k"), F.col("v"), turn).alias("v"), F.lit(True).alias("good")),
        F.struct(_damaged(F.col("k"), F.col("v")).alias("v"), F.lit(False).alias("good")))).alias("w"))
    written = written.withColumn("text", F.concat(F.coalesce("left", F.lit("")), "w.v", F.coalesce("right", F.lit(""))))
    start = F.char_length(F.coalesce("left", F.lit("")))
    end = start + F.char_length("w.v")
    inside = written.select("half", "k", "w", start.alias("start"), end.alias("end"), F.explode(candidate_spans(F.col("text"))).alias("c"))
    inside = inside.filter((F.col("c.s") < F.col("end")) & (F.col("c.e") > F.col("start")))
    whole = (F.col("c.k") == F.col("k")) & (F.col("c.s") <= F.col("start")) & (F.col("c.e") >= F.col("end"))
    return outside.unionByName(inside.select("half", "c", (F.col("w.good") & whole).alias("good")))


def fit(found: DataFrame, loose: DataFrame) -> tuple[Trees, dict[int, float], dict[int, tuple[float, float]]]:
    """Trees from one half of the documents; from the other half a threshold per
    kind, and its (precision, recall) there."""
    table = examples(found, loose).groupBy("half", "c.k", *[F.col(f"c.{f}") for f in FEATURES]).agg(
        F.count_if("good").alias("pos"), F.count_if(~F.col("good")).alias("neg")).collect()

    def part(half):
        own = sorted(tuple(r) for r in table if r["half"] == half)
        a = np.array(own, np.float64).reshape(-1, len(FEATURES) + 4)
        return a[:, 1], a[:, 2:-2].astype(int), a[:, -2], a[:, -1]

    _, x, pos, neg = part(0)
    trees = Trees(x, pos, neg)
    kind, x, pos, neg = part(1)
    scores, limits, reached = trees.scores(x), {}, {}
    for k in range(len(KINDS)):
        for t in sorted(set(scores[kind == k])):
            m = (kind == k) & (scores >= t)
            if pos[m].sum() >= LEAST and pos[m].sum() >= PRECISION * (pos[m].sum() + neg[m].sum()):
                limits[k] = float(t) - 1e-9
                reached[k] = float(pos[m].sum() / (pos[m].sum() + neg[m].sum())), float(pos[m].sum() / pos[kind == k].sum())
                break
    return trees, limits, reached


def spans_found(docs: DataFrame) -> DataFrame:
    """(row, half, doc_id, base, cands): base matches and candidates of every
    text, in the shared folder; ``half`` deals documents to training and calibration."""
    text = F.coalesce("text", F.lit(""))
    found = keyed(docs).select("doc_id", text.alias("text")).select(
        F.monotonically_increasing_id().alias("row"), F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)).alias("half"), "doc_id",
        base_matches(F.col("text")).alias("base"), candidate_spans(F.col("text")).alias("cands"))
    return save(found, "spans")


def find_pii(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, base, spans``: arrays of struct<s, k, e> (start, kind
    number in :data:`KINDS`, end; code points) by start, then kind.

    A null text counts as empty and has no spans; a null id is kept; equal rows
    give equal spans; extra columns are ignored; an empty table gives an empty
    result. Without enough base spans to calibrate a kind nothing is added to it.
    """
    found = spans_found(docs)
    loose = loose_candidates(found)
    trees, limits, _ = fit(found, loose)

    def bare(x: Column) -> Column:
        return F.struct(x.s.alias("s"), x.k.alias("k"), x.e.alias("e"))

    c, passes = F.col("c"), F.lit(False)
    for k, t in limits.items():
        passes = passes | ((c.k == k) & (trees.column(c) >= t))
    more = loose.filter(passes).select(F.col("row").alias("r"), bare(c).alias("x")).distinct().groupBy("r").agg(F.collect_list("x").alias("more"))
    plain = F.transform("base", bare)
    all_ = F.when(F.col("more").isNull(), plain).otherwise(F.array_sort(F.concat(plain, "more")))
    return found.join(more, F.col("row") == F.col("r"), "left").select(shown(), plain.alias("base"), all_.alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s.k + 1), s.s.cast("string"), s.e.cast("string"))))
