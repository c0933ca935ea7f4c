"""Queries over scripts and what is said of them: anchors, chains, alignment, screenplay layout, titles, files.

Five conversations are a film, their turns the blocks of its script.  All of a
block is said, in pieces of six words; some are said later than they stand,
some with another word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sceneline.functions import media as md
from sceneline.functions import text as tx
from sceneline.operators import alignment as al
from sceneline.operators import screenplay as sp
from sceneline.plans.analogs import table
from sceneline.plans.text_queries import sql_tokens

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def script(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(lines, blocks) as :func:`sceneline.operators.alignment.align` takes them."""
    c = table(spark, sf_dir, "conversations").withColumn("movie_key", F.floor(F.col("conv_id") / 5).cast("string"))
    w = Window.partitionBy("movie_key").orderBy("conv_id", "turn")
    blocks = c.select("movie_key", (F.row_number().over(w) - 1).cast("long").alias("block"), tx.tokens(F.col("text")).alias("tokens"))
    starts = F.sequence(F.lit(1), F.size("tokens"), F.lit(6))
    pieces = blocks.where(F.size("tokens") > 0).select("movie_key", "block", F.posexplode(F.transform(starts, lambda i: F.slice("tokens", i, 6))).alias("piece", "tokens"))
    line = F.col("block") * 1000 + F.col("piece") + F.when(F.col("block") % 7 == 3, 4500).otherwise(0)
    said = F.when((F.col("block") % 11 == 5) & (F.col("piece") % 5 == 1), F.concat(F.array(F.lit("zzz")), F.slice("tokens", 2, 5))).otherwise(F.col("tokens"))
    lines = pieces.select("movie_key", line.cast("long").alias("line"), said.alias("tokens"))
    return lines, blocks


_SCRIPT = f"""b AS (SELECT CAST(conv_id // 5 AS VARCHAR) AS movie_key, row_number() OVER (PARTITION BY conv_id // 5 ORDER BY conv_id, turn) - 1 AS block, {sql_tokens("text")} AS h FROM conversations),
p AS (SELECT movie_key, block, piece, list_slice(h, piece * 6 + 1, piece * 6 + 6) AS k FROM (SELECT *, unnest(range((len(h) + 5) // 6)) AS piece FROM b)),
l AS (SELECT movie_key, block * 1000 + piece + CASE WHEN block % 7 = 3 THEN 4500 ELSE 0 END AS line, CASE WHEN block % 11 = 5 AND piece % 5 = 1 THEN list_concat(['zzz'], list_slice(k, 2, 6)) ELSE k END AS k FROM p),
i AS (SELECT * FROM l WHERE len(k) >= 4 OR (len(k) >= 2 AND length(array_to_string(k, ' ')) >= 15 AND array_to_string(k, ' ') NOT IN ('all right', 'come on', 'thank you', 'excuse me', 'i know', 'of course'))),
f AS (SELECT i.movie_key, line, block, k, h, unnest(range(0, len(h) - len(k) + 1)) AS s FROM i JOIN b ON i.movie_key = b.movie_key AND list_has_all(h, k)),
g AS (SELECT movie_key, line, block, s, s + len(k) AS e, CASE WHEN len(k) = len(h) THEN 'anchor_normalized_exact' ELSE 'anchor_unique_substring' END AS method FROM f WHERE list_slice(h, s + 1, s + len(k)) = k),
a AS (SELECT * FROM g QUALIFY count(*) OVER (PARTITION BY movie_key, line) = 1)"""


@query(f"WITH {_SCRIPT} SELECT movie_key, line, block, CAST(s AS INTEGER) AS token_start, CAST(e AS INTEGER) AS token_end, method FROM a")
def script_anchors(spark, sf_dir):
    """Lines that stand at one place of the script."""
    return al.anchors(*script(spark, sf_dir))


@query(f"""WITH RECURSIVE {_SCRIPT}, o AS MATERIALIZED (SELECT movie_key, block * 1000000 + s AS s, block * 1000000 + e AS e, row_number() OVER (PARTITION BY movie_key ORDER BY line) AS i FROM a),
c AS (SELECT DISTINCT movie_key, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS ends FROM o
  UNION ALL SELECT movie_key, i, ends[: n] || [least(coalesce(ends[n + 1], e), e)] || ends[n + 2 :] FROM (SELECT c.movie_key, o.i, o.e, ends, len(list_filter(ends, lambda x: x <= o.s)) AS n FROM c JOIN o ON o.movie_key = c.movie_key AND o.i = c.i + 1))
SELECT movie_key, CAST(len(arg_max(ends, i)) AS BIGINT) AS length, max(i) AS anchors FROM c GROUP BY movie_key""")
def anchor_chain(spark, sf_dir):
    """Length of the longest monotone chain of anchors of each film."""
    found = al.anchors(*script(spark, sf_dir))
    kept = al.anchor_chain(found).groupBy("movie_key").agg(F.count("*").alias("length"))
    return kept.join(found.groupBy("movie_key").agg(F.count("*").alias("anchors")), "movie_key")


@query()
def align_lines(spark, sf_dir):
    """Every line with its status and place."""
    return al.align(*script(spark, sf_dir))


def layout(spark, sf_dir) -> DataFrame:
    """Layout lines of a screenplay for each ten conversations: a slug line, then for each turn a cue and its words, or an action."""
    c = table(spark, sf_dir, "conversations").where("trim(text) <> ''")
    c = c.select((F.floor(F.col("conv_id") / 10)).cast("string").alias("movie_key"), (F.col("conv_id") % 10).cast("int").alias("page"), "conv_id", "turn", "role", "text")
    line = lambda rows, text, x0, y0, block: rows.select("movie_key", "page", F.lit(612.0).alias("width"), text.alias("text"), F.lit(x0).alias("x0"), y0.cast("double").alias("y0"), block.cast("int").alias("source_block"))
    slugs = line(c.select("movie_key", "page", "conv_id").distinct(), F.format_string("%d INT. ROOM - NIGHT", F.col("conv_id") % 10 + 1), 100.0, F.lit(0), F.lit(-1))
    spoken, actions = c.where("role <> 'system'"), c.where("role = 'system'")
    y, words = F.col("turn") * 20 + 10, F.concat(F.lit("so "), "text")  # no line of the text itself looks like a slug or a parenthesis
    return slugs.union(line(spoken, F.upper("role"), 300.0, y, F.col("turn") * 2)).union(line(spoken, words, 200.0, y + 10, F.col("turn") * 2 + 1)).union(line(actions, words, 100.0, y, F.col("turn") * 2))


@query("""WITH c AS (SELECT CAST(conv_id // 10 AS VARCHAR) AS movie_key, conv_id, turn, role, text FROM conversations WHERE trim(text) <> '')
SELECT movie_key, CAST(dense_rank() OVER (PARTITION BY movie_key ORDER BY conv_id) AS INTEGER) AS scene_order, CAST(conv_id % 10 + 1 AS VARCHAR) AS scene_number, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS source_order,
  CASE WHEN role = 'system' THEN 'action' ELSE 'dialogue' END AS block_type, 'so ' || trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, CASE WHEN role <> 'system' THEN upper(role) END AS speaker FROM c""".replace("\\\\", "\\"))
def parse_screenplay(spark, sf_dir):
    return sp.parse(layout(spark, sf_dir)).select("movie_key", "scene_order", "scene_number", "source_order", "block_type", "text", "speaker")


_PATH = "'/in/' || CASE WHEN p_partkey % 4 = 1 THEN 'tt' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') || '_' ELSE '' END || replace(p_brand, '#', '') || '/' || CASE WHEN p_partkey % 4 = 0 THEN 'tt' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') || '_' ELSE '' END || replace(p_name, ' ', 'XyZ') || CASE WHEN p_partkey % 2 = 0 THEN '_cut.two' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN '.mkv' ELSE '.NFO' END"


def _paths(spark, sf_dir):
    k = F.col("p_partkey")
    id_ = F.concat(F.lit("tt"), F.lpad(k.cast("string"), 7, "0"), F.lit("_"))
    some = lambda c, v: F.when(c, v).otherwise(F.lit(""))
    path = F.concat(
        F.lit("/in/"), some(k % 4 == 1, id_), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("/"), some(k % 4 == 0, id_), F.replace("p_name", F.lit(" "), F.lit("XyZ")), some(k % 2 == 0, F.lit("_cut.two")), F.when(k % 3 == 0, ".mkv").otherwise(".NFO")
    )
    return table(spark, sf_dir, "part").select(path.alias("path"))


@query(f"""WITH p AS (SELECT {_PATH} AS path FROM part), q AS (SELECT path, split_part(path, '/', 4) AS name, split_part(path, '/', 3) AS folder FROM p), t AS (SELECT *, regexp_replace(name, '\\.[^.]*$', '') AS stem FROM q)
SELECT path, trim(regexp_replace(regexp_replace(regexp_replace(stem, '(?i)^tt[0-9]{{7,8}}(?:[_. -]+)?', ''), '([a-z])([A-Z])', '\\1 \\2', 'g'), '[_.]+', ' ', 'g')) AS title,
  CASE WHEN regexp_matches(path, 'tt[0-9]{{7}}') THEN regexp_extract(path, 'tt[0-9]{{7,10}}') ELSE folder END AS movie_id, folder AS folder_title, '/in/' || folder || '/' || stem || '_standardized.mp4' AS output, CASE WHEN name LIKE '%.NFO' THEN 'RELEASE_METADATA' ELSE 'UNKNOWN' END AS category FROM t""")
def path_titles(spark, sf_dir):
    """What a path tells: title, identity, where its standardized file goes, category."""
    p = F.col("path")
    return _paths(spark, sf_dir).select("path", md.title_of(p).alias("title"), *md.identity(F.regexp_replace(p, "^/in/", "")), md.standardized(p).alias("output"), md.file_category(p).alias("category"))
