"""Queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tierlens.llm import mixing, pii
from tierlens.llm.compression_rules import compression_rules
from tierlens.llm.exact_dedup import exact_dedup
from tierlens.llm.hard_negatives import hard_negatives, relabelled, scaled
from tierlens.llm.multiset_hash import compare_with_edit, shown_as_text
from tierlens.llm.near_dedup import near_dedup
from tierlens.llm.sentencepiece_bpe import encode_documents
from tierlens.llm.spelling import spelling_variants
from tierlens.llm.substring_dedup import substring_dedup
from tierlens.llm.suffix_dedup import suffix_dedup
from tierlens.llm.tables import read, shown
from tierlens.llm.toxicity import fit, score_documents
from tierlens.llm.warc import archive_pages

QUERIES = {}
ORACLES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_substring_dedup(spark, sf_dir):
    """Words that a 50-word repeat of a smaller document covers, removed."""
    d = substring_dedup(read(spark, sf_dir, "documents"))
    return d.select(shown(), F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def _kind_count(kind: int):
    return F.size(F.filter("base", lambda s: s.k == kind)).cast("bigint").alias(f"n_{pii.KINDS[kind]}")


# every 50-word window by its hash; words of windows that start in a smaller document go
ORACLES["op1_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
     win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
     first AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h HAVING count(*) > 1),
     gone AS (SELECT DISTINCT win.doc_id, win.i + k.range AS p FROM win JOIN first USING (h), range(50) k WHERE m < win.doc_id),
     word AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM w),
     kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
     n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)"""


@query
def op2_pii(spark, sf_dir):
    """Spans of personal data."""
    d = pii.find_pii(read(spark, sf_dir, "documents"))
    counts = [_kind_count(k) for k in range(len(pii.KINDS))]
    return d.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


@query
def op3_exact_dedup(spark, sf_dir):
    """Groups of documents that are equal without white space."""
    d = exact_dedup(read(spark, sf_dir, "documents"))
    return d.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLES["op3_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h,
                  length(coalesce(text, '')) AS n FROM documents),
     k AS (SELECT h, count(*) AS group_size, arg_min(doc_id, {'a': -n, 'b': doc_id}) AS keep_id FROM d GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN k USING (h)"""


@query
def op7_suffix_dedup(spark, sf_dir):
    """Bytes that a 50-byte repeat of a smaller document covers, removed."""
    d = suffix_dedup(read(spark, sf_dir, "documents"))
    return d.select(shown(), F.col("n_units").alias("n_bytes"), "n_removed",
                    F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


# bytes as hexadecimal digits, two each
ORACLES["op7_suffix_dedup"] = r"""
WITH b AS (SELECT doc_id, hex(coalesce(text, '')) AS x, strlen(coalesce(text, '')) AS n FROM documents),
     win AS (SELECT doc_id, i, md5(substr(x, 2 * i - 1, 100)) AS h FROM (SELECT doc_id, x, unnest(range(1, n - 48)) AS i FROM b)),
     first AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h HAVING count(*) > 1),
     hit AS (SELECT win.doc_id, win.i FROM win JOIN first USING (h) WHERE m < win.doc_id),
     run AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS new FROM hit),
     span AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM run) GROUP BY doc_id, g),
     gap AS (SELECT doc_id, a, z, lag(z, 1, 1) OVER (PARTITION BY doc_id ORDER BY a) AS prev FROM span),
     part AS (SELECT b.doc_id, prev AS p, substr(x, 2 * prev - 1, 2 * (a - prev)) AS s FROM gap JOIN b USING (doc_id)
              UNION ALL SELECT b.doc_id, z, substr(x, 2 * z - 1) FROM (SELECT doc_id, max(z) AS z FROM span GROUP BY doc_id) JOIN b USING (doc_id)),
     kept AS (SELECT doc_id, string_agg(s, '' ORDER BY p) AS x FROM part GROUP BY doc_id),
     n AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id)
SELECT b.doc_id, b.n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept.x, b.x))) AS kept_sha256
FROM b LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)"""


@query
def op9_near_dedup(spark, sf_dir):
    """Components of documents whose 3-word shingle sets are at least 85 % alike."""
    return near_dedup(read(spark, sf_dir, "documents"), shingle=3, percent=85)


# exact: pairs by their shared shingles, components by repeated smallest neighbours
ORACLES["op9_near_dedup"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\x20\x09-\x0D]+') AS ws FROM documents),
     s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 2], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)),
     n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
     pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
     link AS (SELECT x, y FROM pair JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 85 * (a.c + b.c - common)),
     edge AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
     reach(doc_id, r) AS (SELECT x, x FROM edge UNION SELECT reach.doc_id, edge.y FROM reach JOIN edge ON reach.r = edge.x),
     comp AS (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.c, 0) AS n_shingles, coalesce(comp.c, w.doc_id) AS component_id, coalesce(comp.c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)"""


@query
def op4_multiset_hash(spark, sf_dir):
    """Fingerprints of texts and edited texts and their likeness."""
    d = compare_with_edit(read(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                    shown_as_text(F.col("vector")).alias("fingerprint"),
                    shown_as_text(F.col("edited_vector")).alias("edited_fingerprint"), "near_edited", "near_next")


@query
def op5_warc_revisit(spark, sf_dir):
    """Pages as WARC archives with revisit records, read back and resolved."""
    return archive_pages(read(spark, sf_dir, "pages"))


ORACLES["op5_warc_revisit"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
     d AS (SELECT page_id, body, strlen(body) AS payload_bytes, sha1(body) AS h, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(1 + ((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d"""


@query
def op6_toxicity(spark, sf_dir):
    """Toxicity scores by compression distance."""
    docs = read(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, read(spark, sf_dir, "labels")))


#: Share of all tokens that the mixture takes, the most epochs of a document, and the seed of the order.
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.7, 2, 13


@query
def op8_mixing(spark, sf_dir):
    """Documents of a mixture with target weights by domain, language and source."""
    docs = mixing.with_domain(read(spark, sf_dir, "documents"))
    return mixing.mix_sources(docs, mixing.table_weights(), MIX_SHARE, MIX_EPOCHS, MIX_SEED)


def _mix_sql() -> str:
    def case(col, table):
        return "CASE " + " ".join(f"WHEN {col} = '{k}' THEN {v}" for k, v in table.items()) + " ELSE 1 END"

    names = "['" + "', '".join(mixing.DOMAIN_NAMES) + "']"
    weight = {"domain": case("domain", mixing.DOMAIN_WEIGHTS), "lang": case("lang", mixing.LANGUAGE_WEIGHTS), "source": "1"}
    parts, plan = [], None
    for depth, name in enumerate(mixing.LEVELS, 1):
        keys, parents = ", ".join(mixing.LEVELS[:depth]), ", ".join(mixing.LEVELS[:depth - 1])
        given = f"(SELECT CAST(floor(sum(have) * {MIX_SHARE}) AS BIGINT) FROM leaf)" if plan is None else "p.given"
        join = "" if plan is None else f" JOIN {plan} p USING ({parents})"
        by = f"PARTITION BY {parents}" if parents else ""
        parts.append(f"""n{depth} AS (SELECT {keys}, c.cap, c.w, {given} AS given FROM
            (SELECT {keys}, CAST(sum(have) AS BIGINT) * {MIX_EPOCHS} AS cap, {weight[name]} AS w FROM leaf GROUP BY {keys}) c{join}),
          l{depth} AS (SELECT *, CAST(given - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / CAST(sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lev FROM n{depth}
            WINDOW o AS ({by} ORDER BY cap / w, {keys})),
          b{depth} AS (SELECT {keys}, least(cap, CAST(floor(greatest(max(lev) OVER ({by}), 0.0) * CAST(w AS DOUBLE)) AS BIGINT)) AS given FROM l{depth})""")
        plan = f"b{depth}"
    return rf"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         {names}[1 + coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)', 1) AS BIGINT), 0) % 3] AS domain,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS n_tokens FROM documents),
      leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS have FROM d GROUP BY ALL),
      {", ".join(parts)},
      plan AS (SELECT domain, lang, source, CASE WHEN have > 0 THEN least(given // have, {MIX_EPOCHS}) ELSE 1 END AS whole, given, have
               FROM b3 JOIN leaf USING (domain, lang, source)),
      o AS (SELECT d.*, whole, given - whole * have AS rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source
               ORDER BY md5('{MIX_SEED}:' || whole || ':' || doc_id), n_tokens ROWS UNBOUNDED PRECEDING) AS upto
            FROM d JOIN plan USING (domain, lang, source)),
      u AS (SELECT *, least(whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END, {MIX_EPOCHS}) AS used FROM o)
      SELECT doc_id, domain, lang, source, n_tokens, epoch FROM (SELECT *, unnest(range(CAST(used AS BIGINT))) AS epoch FROM u)"""


ORACLES["op8_mixing"] = _mix_sql()


@query
def op10_sentencepiece(spark, sf_dir):
    """SentencePiece ids of every text, and the text of the ids."""
    d = encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return d.select(shown(), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op11_compression_rules(spark, sf_dir):
    """Quality counts of every text and the verdict of base rules and compression bands."""
    return compression_rules(read(spark, sf_dir, "documents"))


@query
def op12_hard_negatives(spark, sf_dir):
    """Hard negatives of every anchor and positive."""
    return hard_negatives(relabelled(scaled(read(spark, sf_dir, "embeddings"))))


ORACLES["op12_hard_negatives"] = """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same,
                  CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
           FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
     p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r FROM s WHERE same QUALIFY r <= 5),
     n AS (SELECT p.a AS anchor_id, p.b AS positive_id, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score,
                  CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INTEGER) AS rank
           FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""


@query
def op13_spelling_variants(spark, sf_dir):
    """Frequent words, their near words, the form each belongs to and the root of its chain."""
    return spelling_variants(read(spark, sf_dir, "documents")).select("word", "n", "n_near", "form", "form_n", "root")


# crc32 by its table; near words by the strings that deletions leave
ORACLES["op13_spelling_variants"] = r"""
WITH RECURSIVE bit(i, k, v) AS (SELECT i, 0, CAST(i AS BIGINT) FROM range(256) t(i)
         UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bit WHERE k < 8),
     tab AS (SELECT list(v ORDER BY i) AS t FROM bit WHERE k = 8),
     run AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')),
                                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents WHERE text IS NOT NULL),
     own AS (SELECT doc_id, w, count(*) AS n, hex(encode(doc_id || ':' || w)) AS x FROM run GROUP BY doc_id, w),
     h AS (SELECT doc_id, w, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
                  lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS h FROM own, tab),
     word AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
     v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM word WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
     del AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v)),
     near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM del a JOIN del b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
              UNION SELECT a.word, b.word, b.n FROM del a JOIN v b ON a.d = b.word
              UNION SELECT b.word, a.word, a.n FROM del a JOIN v b ON a.d = b.word),
     best AS (SELECT word, count(*) AS n_near, arg_min(near, {'a': -near_n, 'b': near}) AS w, max(near_n) AS m FROM near GROUP BY word),
     f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * v.n THEN w END AS form, CASE WHEN m >= 5 * v.n THEN m END AS form_n
           FROM v LEFT JOIN best USING (word)),
     chain(word, last, n) AS (SELECT word, form, form_n FROM f WHERE form IS NOT NULL
         UNION ALL SELECT chain.word, f.form, f.form_n FROM chain JOIN f ON f.word = chain.last WHERE f.form IS NOT NULL),
     root AS (SELECT word, arg_max(last, n) AS root FROM chain GROUP BY word)
SELECT f.word, f.n, n_near, form, form_n, coalesce(root, f.word) AS root FROM f LEFT JOIN root USING (word)"""
