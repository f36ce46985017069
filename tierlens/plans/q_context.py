"""Context queries: E3, E4, E13, E14, E16, E17, H21 (routing) and H4, H5, H6, C10, C11 (documents)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierlens.fixtures import register
from tierlens.functions.text import md5_len
from tierlens.operators import context as C
from tierlens.plans import query


def _routed(spark, sf_dir):
    register(spark, sf_dir)
    return spark.table("v_routed").withColumnRenamed("predicted_tier", "tier")


@query("e3_tier_pivots", """
SELECT conv_id, turn, lag(predicted_tier) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_tier,
       coalesce(predicted_tier <> lag(predicted_tier) OVER (PARTITION BY conv_id ORDER BY turn), false) AS is_pivot
FROM v_routed""")
def e3_tier_pivots(spark, sf_dir):
    """A turn pivots when its tier differs from the previous turn's."""
    return C.pivots(_routed(spark, sf_dir)).select("conv_id", "turn", "prev_tier", "is_pivot")


_SEG = """
, pv AS (SELECT *, CASE WHEN predicted_tier <> lag(predicted_tier) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS p FROM v_routed),
sg AS (SELECT *, sum(p) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS segment_id FROM pv)
"""


@query("e4_context_segments", _SEG + """
SELECT conv_id, CAST(segment_id AS BIGINT) AS segment_id, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n_turns,
       CAST(sum(coalesce(length(query), 0) + coalesce(length(response), 0)) AS BIGINT) AS pending_chars
FROM sg GROUP BY conv_id, segment_id""")
def e4_context_segments(spark, sf_dir):
    """Segments between pivots: turns pending until the next pivot folds them into a briefing."""
    s = C.segments(_routed(spark, sf_dir))
    return C.segment_summary(s)


@query("e16_payload_stats", _SEG + """
, c AS (SELECT *, count(*) OVER w AS k, coalesce(sum(coalesce(length(query), 0) + coalesce(length(response), 0)) OVER w, 0) AS ch
        FROM sg WINDOW w AS (PARTITION BY conv_id, segment_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, turn, segment_id > 0 AND (conv_id + segment_id) % 4 <> 1 AS has_briefing, CAST(2 * k AS BIGINT) AS pending_messages, CAST(ch AS BIGINT) AS pending_chars,
       CAST(2 * k + 1 + CASE WHEN segment_id > 0 AND (conv_id + segment_id) % 4 <> 1 THEN 1 ELSE 0 END AS BIGINT) AS n_messages
FROM c""")
def e16_payload_stats(spark, sf_dir):
    """Per request: briefing present (one briefing in four signals a topic shift),
    pending messages and characters, message count."""
    s = C.segments(_routed(spark, sf_dir))
    turn = (F.col("conv_id") + F.col("segment_id")) % 4
    said = F.when(turn == 1, " none. ").when(turn == 2, "None of the earlier points is settled yet").otherwise("Earlier: prices and dates")
    briefings = s.filter("is_pivot").select("conv_id", "segment_id", said.alias("briefing"))
    return C.payload_stats(s, briefings=briefings).select("conv_id", "turn", "has_briefing", "pending_messages", "pending_chars", "n_messages")


@query("e16_latest_payload", _SEG + """
, nw AS (SELECT conv_id, max(turn) AS last_turn, arg_max(segment_id, turn) AS seg FROM sg GROUP BY conv_id),
msgs AS (SELECT s.conv_id, s.turn * 2 AS o, concat('user: ', s.query) AS m FROM sg s JOIN nw ON s.conv_id = nw.conv_id
           WHERE s.segment_id = nw.seg AND s.turn < nw.last_turn
         UNION ALL SELECT s.conv_id, s.turn * 2 + 1, concat('assistant: ', s.response) FROM sg s JOIN nw ON s.conv_id = nw.conv_id
           WHERE s.segment_id = nw.seg AND s.turn < nw.last_turn
         UNION ALL SELECT s.conv_id, s.turn * 2, concat('user: ', s.query) FROM sg s JOIN nw ON s.conv_id = nw.conv_id AND s.turn = nw.last_turn)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_messages, md5(string_agg(m, chr(10) ORDER BY o)) AS payload_md5 FROM msgs GROUP BY conv_id""")
def e16_latest_payload(spark, sf_dir):
    """Payload of the newest request per conversation: open segment's turns, then the query."""
    s = C.segments(_routed(spark, sf_dir))
    p = C.latest_payload(s)
    rendered = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    return p.select("conv_id", F.size("messages").cast("bigint").alias("n_messages"), F.md5(rendered).alias("payload_md5"))


@query("e13_compaction_schedule", """
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS call_no,
       row_number() OVER (PARTITION BY conv_id ORDER BY turn) >= 4 AND (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 4) % 2 = 0 AS compact_before
FROM v_turn""")
def e13_compaction_schedule(spark, sf_dir):
    """Calls before which the router log is compacted (interval 5: calls 4, 6, 8, ...)."""
    register(spark, sf_dir)
    d = C.compaction_schedule(spark.table("v_turn"))
    return d.select("conv_id", "turn", F.col("call_no").cast("bigint").alias("call_no"), "compact_before")


@query("e14_context_text", """
SELECT conv_id, md5(string_agg(concat('[', role, ']: ', text), concat(chr(10), chr(10)) ORDER BY turn)) AS context_md5,
       CAST(length(string_agg(concat('[', role, ']: ', text), concat(chr(10), chr(10)) ORDER BY turn)) AS BIGINT) AS context_len
FROM conversations GROUP BY conv_id""")
def e14_context_text(spark, sf_dir):
    """Context text per conversation: ``[role]: content`` blocks, blank line between."""
    register(spark, sf_dir)
    c = C.context_text(spark.table("conversations"))
    return c.select("conv_id", *md5_len(F.col("context"), "context"))


@query("e14_context_blocks", """
, e AS (SELECT conv_id, turn, concat('[', role, ']: ', text) AS b FROM conversations),
pl AS (SELECT *, coalesce(sum(length(b) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM e)
SELECT conv_id, CAST(p // 300 AS BIGINT) AS block_no, md5(string_agg(b, concat(chr(10), chr(10)) ORDER BY turn)) AS text_md5 FROM pl GROUP BY conv_id, p // 300""")
def e14_context_blocks(spark, sf_dir):
    """Context text per conversation in blocks of about 300 characters."""
    register(spark, sf_dir)
    return C.context_blocks(spark.table("conversations"), block_chars=300).select("conv_id", "block_no", F.md5("text").alias("text_md5"))


@query("e17_latest_input", """
SELECT conv_id, md5(arg_max(text, turn)) AS input_md5 FROM conversations WHERE role IN ('user', 'tool_result') GROUP BY conv_id""")
def e17_latest_input(spark, sf_dir):
    """Newest user (or tool-result) input per conversation."""
    register(spark, sf_dir)
    m = spark.table("conversations").withColumn("tool_name", F.lit(None).cast("string"))
    return C.latest_input(m).select("conv_id", F.md5("latest_input").alias("input_md5"))


@query("h21_briefing_rule", r"""
, b AS (SELECT conv_id, turn, regexp_replace(CASE (conv_id + turn) % 4 WHEN 0 THEN 'NONE' WHEN 1 THEN '  none.  '
                 WHEN 2 THEN concat('NONE ', text) ELSE text END, '^\s+|\s+$', '', 'g') AS s FROM conversations)
SELECT conv_id, turn, md5(CASE WHEN contains(upper(s), 'NONE') AND length(s) < 15 THEN '' ELSE s END) AS briefing_md5 FROM b""")
def h21_briefing_rule(spark, sf_dir):
    """Briefing text after the topic-shift rule (short answers containing NONE clear it)."""
    register(spark, sf_dir)
    c = spark.table("conversations")
    k = (F.col("conv_id") + F.col("turn")) % 4
    cand = (F.when(k == 0, F.lit("NONE")).when(k == 1, F.lit("  none.  "))
             .when(k == 2, F.concat(F.lit("NONE "), F.col("text"))).otherwise(F.col("text")))
    return c.select("conv_id", "turn", F.md5(C.briefing_after_rule(cand)).alias("briefing_md5"))


# ---- skill files from documents (shared by both engines; chr(10) avoids escape differences)
_SKILL_FILES = """
SELECT doc_id,
  CASE WHEN doc_id % 3 = 0 THEN 'global' ELSE 'local' END AS layer,
  concat(lower(source), '-', lang, '-', CAST(doc_id AS STRING)) AS dir_name,
  concat('/', CASE WHEN doc_id % 3 = 0 THEN 'global' ELSE 'local' END, '/skills/',
         concat(lower(source), '-', lang, '-', CAST(doc_id AS STRING)), '/SKILL.md') AS path,
  concat('---', chr(10),
    CASE doc_id % 5 WHEN 0 THEN concat('name: ', lower(source), '-', lang, chr(10))
                    WHEN 1 THEN concat('name: "', lower(source), '-', lang, '"', chr(10))
                    WHEN 2 THEN concat('  name :  ', lower(source), chr(10), '# note: ignored', chr(10))
                    WHEN 3 THEN ''
                    ELSE concat('name: Bad--Name_', CAST(doc_id AS STRING), '-', chr(10)) END,
    CASE doc_id % 7 WHEN 0 THEN ''
                    WHEN 1 THEN concat('description: ''Skill for ', source, '''', chr(10))
                    ELSE concat('description: Notes in ', lang, ' from ', source, chr(10), 'description: Notes (', lang, ')', chr(10)) END,
    CASE WHEN doc_id % 11 = 0 THEN '' ELSE concat('---', chr(10)) END,
    text) AS content
FROM documents"""

_FM_SQL = r"""
, sk AS (""" + _SKILL_FILES + r"""),
fm AS (SELECT doc_id, regexp_extract(content, '(?s)^---(.*?)\n---\s*\n', 1) AS block,
              regexp_matches(content, '(?s)^---.*?\n---\s*\n') AS has FROM sk),
ln AS (SELECT doc_id, unnest(string_split(block, chr(10))) AS raw, generate_subscripts(string_split(block, chr(10)), 1) AS pos FROM fm WHERE has),
l2 AS (SELECT doc_id, pos, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS line FROM ln),
kv AS (SELECT doc_id, pos, regexp_replace(split_part(line, ':', 1), '^\s+|\s+$', '', 'g') AS key,
              regexp_replace(regexp_extract(line, '^[^:]*:(.*)$', 1), '^\s+|\s+$', '', 'g') AS v0
       FROM l2 WHERE line <> '' AND NOT starts_with(line, '#') AND contains(line, ':')),
kv2 AS (SELECT doc_id, pos, key, CASE WHEN length(v0) > 0 AND left(v0, 1) IN ('"', '''') AND right(v0, 1) = left(v0, 1)
                                      THEN substring(v0, 2, length(v0) - 2) ELSE v0 END AS value FROM kv),
pairs AS (SELECT doc_id, key, arg_max(value, pos) AS value FROM kv2 GROUP BY doc_id, key)
"""


def _skill_files(spark, sf_dir):
    register(spark, sf_dir)
    return spark.sql(_SKILL_FILES)


@query("h4_frontmatter", _FM_SQL + "SELECT doc_id, key, value FROM pairs")
def h4_frontmatter(spark, sf_dir):
    """Frontmatter key/value pairs of every skill file (last duplicate wins)."""
    f = _skill_files(spark, sf_dir)
    return f.select("doc_id", F.explode(C.frontmatter(F.col("content"))).alias("key", "value"))


_SKILLS_SQL = _FM_SQL + r""",
sk2 AS (SELECT s.doc_id, s.layer, s.dir_name, s.path,
               coalesce(nullif(n.value, ''), s.dir_name) AS name, coalesce(d.value, '') AS description
        FROM sk s LEFT JOIN pairs n ON n.doc_id = s.doc_id AND n.key = 'name'
                  LEFT JOIN pairs d ON d.doc_id = s.doc_id AND d.key = 'description'),
chk AS (SELECT *, regexp_replace(description, '^\s+|\s+$', '', 'g') <> '' AS loaded,
  concat_ws('|',
    CASE WHEN name <> dir_name THEN concat('name "', name, '" does not match directory "', dir_name, '"') END,
    CASE WHEN length(name) > 64 THEN 'name exceeds 64 characters' END,
    CASE WHEN NOT regexp_matches(name, '^[a-z0-9-]+$') THEN 'name must be lowercase a-z, 0-9, hyphens only' END,
    CASE WHEN starts_with(name, '-') OR ends_with(name, '-') THEN 'name must not start or end with hyphen' END,
    CASE WHEN contains(name, '--') THEN 'name must not contain consecutive hyphens' END,
    CASE WHEN regexp_replace(description, '^\s+|\s+$', '', 'g') = '' THEN 'description is required' END,
    CASE WHEN length(description) > 1024 THEN 'description exceeds 1024 characters' END) AS warnings
  FROM sk2)
"""


@query("h5_skill_checks", _SKILLS_SQL + "SELECT doc_id, name, loaded, warnings FROM chk")
def h5_skill_checks(spark, sf_dir):
    """Skill rule checks: name / description warnings; skills without a description are not loaded."""
    s = C.load_skills(_skill_files(spark, sf_dir))
    return s.select("doc_id", "name", "loaded", F.array_join("warnings", "|").alias("warnings"))


@query("c11_skill_overlay", _SKILLS_SQL + """
, w AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE layer WHEN 'local' THEN 0 ELSE 1 END, path) AS rn FROM chk WHERE loaded),
wn AS (SELECT name, path AS winner_path FROM w WHERE rn = 1)
SELECT w.name, w.path, w.layer, w.rn = 1 AS is_winner,
       CASE WHEN w.rn > 1 THEN concat('name collision: "', w.name, '" already loaded from ', wn.winner_path) END AS warning
FROM w JOIN wn ON w.name = wn.name""")
def c11_skill_overlay(spark, sf_dir):
    """Local skills beat global ones per name; losers reported as collisions."""
    return C.overlay_skills(C.load_skills(_skill_files(spark, sf_dir)))


@query("h6_skills_section", _SKILLS_SQL + """
, w AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE layer WHEN 'local' THEN 0 ELSE 1 END, path) AS rn FROM chk WHERE loaded),
esc AS (SELECT layer, name, path,
  concat('<skill>', chr(10), '<name>', replace(replace(replace(replace(replace(name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;'),
         '</name>', chr(10), '<description>', replace(replace(replace(replace(replace(description, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;'),
         '</description>', chr(10), '<location>', replace(replace(replace(replace(replace(path, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;'),
         '</location>', chr(10), '</skill>') AS b FROM w WHERE rn = 1)
SELECT layer, name, path, md5(b) AS block_md5 FROM esc""")
def h6_skills_section(spark, sf_dir):
    """Skills prompt-section blocks of the overlay winners (escaped), one row
    per skill; the section is these blocks in (name, path) order between the
    fixed head and tail, so no catalogue is gathered into one row."""
    skills = C.load_skills(_skill_files(spark, sf_dir))
    win = C.overlay_skills(skills).filter("is_winner").select("name", "path", "layer")
    full = win.join(skills.select("path", "description"), "path")
    return C.skill_blocks(full).select("layer", "name", "path", F.md5("block").alias("block_md5"))


# ---- guideline files from pages
_GUIDE = """
, pg AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
                regexp_extract(url, '^https?://[^/]+/([a-z]+)', 1) AS lang, html FROM pages),
gf AS (SELECT CASE page_id % 3 WHEN 0 THEN concat('/', host) WHEN 1 THEN concat('/', host, '/', lang)
                   ELSE concat('/', host, '/', lang, '/', CAST(page_id AS VARCHAR)) END AS dir,
              CASE page_id % 4 WHEN 0 THEN 'AGENTS.md' WHEN 1 THEN 'CLAUDE.md' WHEN 2 THEN 'AGENTS.md' ELSE 'README.md' END AS file_name,
              html AS content FROM pg),
gf2 AS (SELECT dir, file_name, concat(dir, '/', file_name) AS path, content,
               CASE file_name WHEN 'AGENTS.md' THEN 1 WHEN 'CLAUDE.md' THEN 2 END AS prio FROM gf),
best AS (SELECT dir, path, content FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY prio, path, content) AS rn
                                         FROM gf2 WHERE prio IS NOT NULL) WHERE rn = 1),
wd AS (SELECT concat('/', host, '/', lang, '/', CAST(page_id AS VARCHAR)) AS cwd, concat('/', host) AS stop_dir, host, lang, page_id FROM pg),
anc AS (SELECT cwd, 0 AS depth, stop_dir AS dir FROM wd
        UNION ALL SELECT cwd, 1, concat(stop_dir, '/', lang) FROM wd
        UNION ALL SELECT cwd, 2, cwd FROM wd),
gl AS (SELECT a.cwd, a.depth, b.path, b.content FROM anc a JOIN best b ON a.dir = b.dir)
"""


def _guide_inputs(spark, sf_dir):
    register(spark, sf_dir)
    pg = spark.table("pages").select(
        "page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"),
        F.regexp_extract("url", r"^https?://[^/]+/([a-z]+)", 1).alias("lang"), "html")
    k3, k4 = F.col("page_id") % 3, F.col("page_id") % 4
    d = (F.when(k3 == 0, F.concat(F.lit("/"), "host")).when(k3 == 1, F.concat(F.lit("/"), "host", F.lit("/"), "lang"))
          .otherwise(F.concat(F.lit("/"), "host", F.lit("/"), "lang", F.lit("/"), F.col("page_id").cast("string"))))
    fn = F.when(k4 == 0, "AGENTS.md").when(k4 == 1, "CLAUDE.md").when(k4 == 2, "AGENTS.md").otherwise("README.md")
    files = pg.select(d.alias("dir"), fn.alias("file_name"), F.col("html").alias("content")) \
              .withColumn("path", F.concat("dir", F.lit("/"), "file_name"))
    wd = pg.select(F.concat(F.lit("/"), "host", F.lit("/"), "lang", F.lit("/"), F.col("page_id").cast("string")).alias("cwd"),
                   F.concat(F.lit("/"), "host").alias("stop_dir"))
    return wd, files


@query("c10_guideline_files", _GUIDE + "SELECT cwd, depth, path, md5(content) AS content_md5 FROM gl")
def c10_guideline_files(spark, sf_dir):
    """Guideline files of every ancestor directory of each working directory, root first."""
    wd, files = _guide_inputs(spark, sf_dir)
    g = C.guideline_files(wd, files)
    return g.select("cwd", F.col("depth").cast("int").alias("depth"), "path", F.md5("content").alias("content_md5"))


@query("h6_guidelines_section", _GUIDE + """
, esc AS (SELECT cwd, depth, concat('<file path="', replace(replace(replace(replace(replace(path, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;'),
           '">', chr(10), replace(replace(replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;'),
           chr(10), '</file>') AS b FROM gl)
SELECT cwd, md5(concat('# Project Context', chr(10), chr(10), 'Project guidelines for coding agents.', chr(10), chr(10), '<project_guidelines>', chr(10),
                       string_agg(b, chr(10) ORDER BY depth), chr(10), '</project_guidelines>')) AS section_md5
FROM esc GROUP BY cwd""")
def h6_guidelines_section(spark, sf_dir):
    """Project-guidelines prompt section per working directory (escaped, depth order)."""
    wd, files = _guide_inputs(spark, sf_dir)
    return C.guidelines_section(C.guideline_files(wd, files)).select("cwd", F.md5("section").alias("section_md5"))
