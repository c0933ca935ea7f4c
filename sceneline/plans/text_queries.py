"""Queries over text: tokens, cleaning, language, containment, retrieval, rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sceneline.functions import text as tx
from sceneline.operators import matching as mt
from sceneline.operators import rescue
from sceneline.operators.mining import rule_matches
from sceneline.operators.subtitles import first_of_each
from sceneline.plans.analogs import BLOCKS_SQL, blocks, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
_TOK = r"[\p{L}\p{N}_]+(?:''[\p{L}\p{N}_]+)?"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def sql_tokens(col: str) -> str:
    return f"regexp_extract_all(lower({col}), '{_TOK}')"


@query(f"""SELECT t AS token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (
  SELECT doc_id, unnest({sql_tokens("text")}) AS t FROM documents) GROUP BY t""")
def token_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.tokens(F.col("text"))).alias("token"))
    per = d.groupBy("token", "doc_id").agg(F.count("*").alias("c"))
    return per.groupBy("token").agg(F.sum("c").alias("n"), F.count("*").alias("docs"))


@query(f"""WITH {BLOCKS_SQL}, t AS (SELECT scene_id, source_order, {sql_tokens("text")} AS k FROM b) SELECT scene_id, source_order, len(k) AS n_tokens,
  len(k) >= 4 OR (len(k) >= 2 AND length(array_to_string(k, ' ')) >= 15 AND array_to_string(k, ' ') NOT IN ('all right', 'come on', 'thank you', 'excuse me', 'i know', 'of course')) AS informative FROM t""")
def informative_lines(spark, sf_dir):
    k = tx.tokens(F.col("text"))
    return blocks(spark, sf_dir).select("scene_id", "source_order", F.size(k).cast("long").alias("n_tokens"), tx.informative(k).alias("informative"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[\s\x{a0}]+', ' ', 'g')) AS text FROM pages""")
def clean_tagged_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.clean(F.col("html")).alias("text"))


@query("""SELECT doc_id, CASE WHEN z > 0 AND z >= l THEN 'zh' WHEN l > 0 THEN 'en' ELSE 'und' END AS detected FROM (
  SELECT doc_id, len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]')) AS z, len(regexp_extract_all(text, '[A-Za-z]')) AS l FROM documents)""".replace("\\\\", "\\"))
def language_detect(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.language(F.col("text")).alias("detected"))


@query("SELECT min(doc_id) AS doc_id, lower(trim(text)) AS norm FROM documents GROUP BY lower(trim(text))")
def dedupe_normalized(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("norm", F.lower(F.trim("text")))
    return first_of_each(d.select("doc_id", "norm"), ["norm"], ["doc_id"])


_UNITS = f"""i AS (SELECT item_id, {sql_tokens("text")} AS k FROM benchmark), d AS (SELECT doc_id, {sql_tokens("text")} AS h FROM documents),
p AS (SELECT item_id, doc_id, unnest(range(0, len(h) - len(k) + 1)) AS s, k, h FROM i, d WHERE len(k) > 0 AND list_has_all(h, k)),
c AS (SELECT item_id, doc_id, CAST(s AS INTEGER) AS token_start, len(k) AS line_tokens, len(h) AS block_tokens FROM p WHERE list_slice(h, s + 1, s + len(k)) = k)"""


def _units(spark, sf_dir):
    lines = table(spark, sf_dir, "benchmark").select(F.lit(1).alias("movie"), "item_id", tx.tokens(F.col("text")).alias("tokens"))
    docs = table(spark, sf_dir, "documents").select(F.lit(1).alias("movie"), "doc_id", tx.tokens(F.col("text")).alias("tokens"))
    return lines.where(F.size("tokens") > 0), docs


@query(f"WITH {_UNITS} SELECT item_id, doc_id, token_start, CAST(line_tokens AS INTEGER) AS line_tokens, CAST(block_tokens AS INTEGER) AS block_tokens FROM c")
def containment_anchors(spark, sf_dir):
    """Whole benchmark items in documents."""
    lines, docs = _units(spark, sf_dir)
    return mt.containment_join(lines, docs, ["movie"], "item_id", "doc_id").drop("movie")


@query(f"WITH {_UNITS}, n AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS n FROM c) SELECT item_id, doc_id, token_start FROM n WHERE n = 1")
def unique_anchors(spark, sf_dir):
    lines, docs = _units(spark, sf_dir)
    return mt.unique_places(mt.containment_join(lines, docs, ["movie"], "item_id", "doc_id"), ["movie"], "item_id").select("item_id", "doc_id", "token_start")


@query(f"""WITH i AS (SELECT DISTINCT item_id, unnest({sql_tokens("text")}) AS t FROM benchmark), b AS (SELECT DISTINCT conv_id * 100 + turn AS block, unnest({sql_tokens("text")}) AS t FROM conversations),
il AS (SELECT * FROM i WHERE t IN (SELECT t FROM b)), n AS (SELECT item_id, count(*) AS n FROM il GROUP BY item_id),
s AS (SELECT item_id, block, count(*) AS shared FROM il JOIN b USING (t) GROUP BY ALL HAVING count(*) >= 2),
r AS (SELECT *, shared / n AS score, row_number() OVER (PARTITION BY item_id ORDER BY shared / n DESC, block) AS rank FROM s JOIN n USING (item_id))
SELECT item_id, block, shared, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def lexical_rescue_topk(spark, sf_dir):
    lines = table(spark, sf_dir, "benchmark").select(F.lit(1).alias("movie"), "item_id", tx.tokens(F.col("text")).alias("tokens"))
    turns = table(spark, sf_dir, "conversations").select(F.lit(1).alias("movie"), F.expr("conv_id * 100 + turn").alias("block"), tx.tokens(F.col("text")).alias("tokens"))
    found = mt.overlap_top_k(lines, turns, ["movie"], "item_id", "block", "tokens", 5)
    return found.select("item_id", "block", "shared", F.round("score", 6).alias("score"), "rank")


#: The evidence rules (id, category, pattern, matched without regard to case).
RULES = (
    ("emotion_tears_v1", "emotion", r"\b(?:cr(?:y|ies|ied|ying)|sob(?:s|bed|bing)?|weep(?:s|ing)?|tearful|in tears)\b"),
    ("emotion_laughter_v1", "emotion", r"\b(?:laugh(?:s|ed|ing)?|chuckl(?:e|es|ed|ing)|giggl(?:e|es|ed|ing)|smil(?:e|es|ed|ing)|grin(?:s|ned|ning)?)\b"),
    ("emotion_distress_v1", "emotion", r"\b(?:angry|furious|upset|terrified|frightened|afraid|panicked|devastated|nervous)\b"),
    ("reaction_v1", "reaction", r"\b(?:react(?:s|ed|ing)?|flinch(?:es|ed|ing)?|freeze(?:s|ing)?|realiz(?:e|es|ed|ing)|notic(?:e|es|ed|ing)|stare(?:s|d|ing)?|gasp(?:s|ed|ing)?)\b"),
    ("silence_pause_v1", "silence", r"\b(?:silence|silent|pause(?:s|d)?|a beat|hesitat(?:e|es|ed|ing)|wait(?:s|ed|ing)?)\b"),
    ("physical_contact_v1", "physical_action", r"\b(?:grab(?:s|bed|bing)?|slap(?:s|ped|ping)?|punch(?:es|ed|ing)?|hit(?:s|ting)?|kiss(?:es|ed|ing)?|hug(?:s|ged|ging)?)\b"),
    ("physical_expression_v1", "physical_action", r"\b(?:trembl(?:e|es|ed|ing)|shak(?:e|es|ing)|nod(?:s|ded|ding)?|pace(?:s|d|ing)|kneel(?:s|ed|ing)?)\b"),
    ("conflict_v1", "conflict", r"\b(?:argu(?:e|es|ed|ing)|shout(?:s|ed|ing)?|yell(?:s|ed|ing)?|scream(?:s|ed|ing)?|threaten(?:s|ed|ing)?|fight(?:s|ing)?)\b"),
)
#: The turns hold invented words that no rule meets, so each turn is read with a line of direction
#: from this list, chosen by its place.
LINES = ("She laughs and grabs his arm.", "A long silence. He waits.", "They argue; he is furious.", "He nods.", "Nobody moves.", "She notices the door, trembling, in tears.", "He shouts")
#: Fixed weights: evidence of an action block, and of a spoken one.
ACTION_WEIGHT, SPOKEN_WEIGHT = 0.45, 0.25


_DIRECTED = f"""{BLOCKS_SQL}, t AS (SELECT scene_id, source_order, speaker, block_type, coalesce(text, '') || ' ' || list_extract([{", ".join(f"'{x}'" for x in LINES)}], CAST((scene_id * 5 + source_order) % {len(LINES)} + 1 AS BIGINT)) AS line FROM b),
e AS ({" UNION ALL ".join(f"SELECT scene_id, source_order, '{r}' AS rule_id, '{c}' AS category, CAST(CASE WHEN block_type = 'action' THEN {ACTION_WEIGHT} ELSE {SPOKEN_WEIGHT} END AS DOUBLE) AS weight FROM t WHERE regexp_matches(line, '{p}', 'i')" for r, c, p in RULES)})"""


@query(f"WITH {_DIRECTED} SELECT * FROM e")
def rule_evidence(spark, sf_dir):
    return _evidence(spark, sf_dir)


def _evidence(spark, sf_dir):
    direction = F.element_at(F.array(*map(F.lit, LINES)), ((F.col("scene_id") * 5 + F.col("source_order")) % len(LINES) + 1).cast("int"))
    line = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), direction)
    found = rule_matches(line, [(r, c, f"(?i){p}") for r, c, p in RULES])
    weight = F.when(F.col("block_type") == "action", ACTION_WEIGHT).otherwise(SPOKEN_WEIGHT).alias("weight")
    return blocks(spark, sf_dir).select("scene_id", "source_order", weight, F.explode(found).alias("e")).select("scene_id", "source_order", "e.*", "weight")


@query(f"""WITH {_DIRECTED},
m AS (SELECT scene_id, category, max(weight) AS w FROM e GROUP BY ALL), sp AS (SELECT scene_id, count(DISTINCT speaker) AS n FROM b GROUP BY ALL), s AS (SELECT scene_id, sum(w) AS w FROM m GROUP BY ALL)
SELECT sp.scene_id, round(least(1.0e0, coalesce(w, 0) + CASE WHEN n >= 2 THEN 0.2 ELSE 0 END), 4) AS semantic_score,
  CASE WHEN least(1.0, coalesce(w, 0) + CASE WHEN n >= 2 THEN 0.2 ELSE 0 END) >= 0.8 THEN 'high' WHEN least(1.0, coalesce(w, 0) + CASE WHEN n >= 2 THEN 0.2 ELSE 0 END) >= 0.45 THEN 'medium' ELSE 'none' END AS band FROM sp LEFT JOIN s USING (scene_id)""")
def semantic_score(spark, sf_dir):
    """Families are maxed, then summed; two speakers add; capped at 1; banded."""
    best = _evidence(spark, sf_dir).groupBy("scene_id", "category").agg(F.max("weight").alias("w")).groupBy("scene_id").agg(F.sum("w").alias("w"))
    sp = blocks(spark, sf_dir).groupBy("scene_id").agg(F.count_distinct("speaker").alias("n"))
    score = F.least(F.lit(1.0), F.coalesce("w", F.lit(0.0)) + F.when(F.col("n") >= 2, 0.2).otherwise(0.0))
    band = F.when(score >= 0.8, "high").when(score >= 0.45, "medium").otherwise("none")
    return sp.join(best, "scene_id", "left").select("scene_id", F.round(score, 4).alias("semantic_score"), band.alias("band"))


@query(f"""WITH {BLOCKS_SQL}, a AS (SELECT DISTINCT lower(split_part(r_name, ' ', 1)) AS alias FROM region UNION SELECT unnest(['the', 'and', 'la', 'le', 'der'])),
m AS (SELECT scene_id, source_order, alias FROM b, a WHERE contains(' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || alias || ' '))
SELECT scene_id, alias, count(*) AS mentions, min(source_order) AS first_mention FROM m GROUP BY ALL""")
def alias_mentions(spark, sf_dir):
    """Whole-word mentions of a small alias table: words of the text joined with it by equality."""
    region = table(spark, sf_dir, "region").select(F.lower(F.split_part("r_name", F.lit(" "), F.lit(1))).alias("alias"))
    fixed = spark.createDataFrame([(a,) for a in ("the", "and", "la", "le", "der")], "alias string")
    alias = region.union(fixed).distinct()
    words = blocks(spark, sf_dir).select("scene_id", "source_order", F.explode(F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), " "))).alias("alias"))
    return words.join(alias, "alias").groupBy("scene_id", "alias").agg(F.count("*").alias("mentions"), F.min("source_order").alias("first_mention"))


@query(f"""WITH {BLOCKS_SQL}, o AS (
  SELECT *, last_value(CASE WHEN block_type = 'action' THEN source_order END IGNORE NULLS) OVER (PARTITION BY scene_id ORDER BY source_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_action,
    first_value(CASE WHEN block_type = 'action' THEN source_order END IGNORE NULLS) OVER (PARTITION BY scene_id ORDER BY source_order ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_action,
    CAST(row_number() OVER (ORDER BY scene_id, source_order) - 1 AS BIGINT) AS global_order FROM b
) SELECT scene_id, source_order, previous_action, next_action FROM o WHERE block_type = 'dialogue'""")
def prev_next_action(spark, sf_dir):
    from sceneline.operators.sequences import nearest_where

    o = nearest_where(blocks(spark, sf_dir), "scene_id", ["source_order"], F.col("block_type") == "action", "source_order", "previous_action", "next_action")
    return o.where("block_type = 'dialogue'").select("scene_id", "source_order", "previous_action", "next_action")


@query(f"""WITH {BLOCKS_SQL} SELECT scene_id, source_order, row_number() OVER (PARTITION BY scene_id, block_type ORDER BY source_order) - 1 AS type_order,
  list_aggregate(list_distinct(list(speaker) OVER (PARTITION BY scene_id ORDER BY source_order)), 'count') AS speakers_so_far FROM b""")
def block_ordinals(spark, sf_dir):
    w = Window.partitionBy("scene_id")
    return blocks(spark, sf_dir).select(
        "scene_id",
        "source_order",
        (F.row_number().over(Window.partitionBy("scene_id", "block_type").orderBy("source_order")) - 1).cast("long").alias("type_order"),
        F.size(F.collect_set("speaker").over(w.orderBy("source_order").rowsBetween(Window.unboundedPreceding, 0))).cast("long").alias("speakers_so_far"),
    )


@query(f"""WITH {BLOCKS_SQL}, r AS (SELECT scene_id, speaker, min(source_order) AS f FROM b GROUP BY ALL) SELECT scene_id, string_agg(speaker, '>' ORDER BY f) AS speakers, count(*) AS n FROM r GROUP BY scene_id""")
def first_seen_speakers(spark, sf_dir):
    """Distinct speakers in the order of their first words."""
    first = blocks(spark, sf_dir).groupBy("scene_id", "speaker").agg(F.min("source_order").alias("f"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("f", "speaker"))), lambda x: x["speaker"])
    return first.groupBy("scene_id").agg(F.array_join(names, ">").alias("speakers"), F.count("*").alias("n"))


@query()
def fuzzy_best_block(spark, sf_dir):
    """Best of all turns for a benchmark item by the fuzzy score."""
    lines = table(spark, sf_dir, "benchmark").select(F.lit("1").alias("movie_key"), F.col("item_id").alias("line"), tx.tokens(F.col("text")).alias("tokens"))
    turns = table(spark, sf_dir, "conversations").select(F.lit("1").alias("movie_key"), F.expr("conv_id * 100 + turn").alias("block"), tx.tokens(F.col("text")).alias("tokens"))
    return rescue.best_fuzzy(lines, turns).select(F.col("line").alias("item_id"), "block", F.col("score").alias("fuzzy"))


@query(r"SELECT item_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+(?:''[\p{L}\p{N}_]+)?')) AS INTEGER) AS n FROM benchmark")
def folded_token_counts(spark, sf_dir):
    """NFKC and case folding, by an Arrow UDF."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(tx.folded_tokens("text")).alias("n"))
