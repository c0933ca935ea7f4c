"""Queries of classification, evaluation, constraints and vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sceneline.functions import media as md
from sceneline.operators import constraints as ct
from sceneline.operators import evaluate as ev
from sceneline.operators import media as mo
from sceneline.operators import verify as vf
from sceneline.operators.sequences import stratified_pilot
from sceneline.plans.analogs import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# A part is a media file: its size a codec and depth, its price a size and its key a resolution.
_FILES = """x AS (
  SELECT p_partkey AS file, CASE WHEN p_size % 3 = 0 THEN 'h264' WHEN p_size % 3 = 1 THEN 'hevc' ELSE 'mpeg2' END AS codec, CASE WHEN p_size > 40 THEN 10 ELSE 8 END AS depth,
    p_retailprice / 400 AS gib, CAST(1280 + p_partkey % 1500 AS BIGINT) AS width, CAST(700 + p_partkey % 800 AS BIGINT) AS height, p_type = 'PROMO' AS hdr, 20 + p_size / 2.0e0 AS fps, p_brand AS folder, p_name AS name,
    p_partkey % 150 AS minutes FROM part
), rs AS (
  SELECT *, concat_ws(',', CASE WHEN hdr THEN 'hdr' END, CASE WHEN gib > 4.5 THEN 'oversize' END, CASE WHEN width > 1920 OR height > 1080 THEN 'resolution' END,
    CASE WHEN depth > 8 THEN 'bit_depth' END, CASE WHEN codec NOT IN ('h264', 'hevc') THEN 'codec' END) AS reasons FROM x
)"""


def media_files(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("file"),
        F.when(F.col("p_size") % 3 == 0, "h264").when(F.col("p_size") % 3 == 1, "hevc").otherwise("mpeg2").alias("codec"),
        F.when(F.col("p_size") > 40, 10).otherwise(8).alias("depth"),
        (F.col("p_retailprice") / 400).alias("gib"),
        (1280 + F.col("p_partkey") % 1500).alias("width"),
        (700 + F.col("p_partkey") % 800).alias("height"),
        (F.col("p_type") == "PROMO").alias("hdr"),
        (20 + F.col("p_size") / 2.0).alias("fps"),
        F.col("p_brand").alias("folder"),
        F.col("p_name").alias("name"),
        (F.col("p_partkey") % 150).alias("minutes"),
    )


def _reasons():
    c = F.col
    return md.profile_reasons(c("hdr"), c("gib"), c("width"), c("height"), c("depth"), c("codec"))


@query(f"WITH {_FILES} SELECT file, reasons, CASE WHEN hdr THEN 'HDR_TONEMAP' WHEN gib > 4.5 THEN 'OVERSIZE' WHEN reasons <> '' THEN 'TRANSCODE' ELSE 'PASS' END AS class FROM rs")
def media_classification(spark, sf_dir):
    return media_files(spark, sf_dir).select("file", F.array_join(_reasons(), ",").alias("reasons"), md.inventory_class(_reasons()).alias("class"))


@query(f"""WITH {_FILES}, t AS (SELECT *, least(1.0e0, 1920 / width, 1080 / height) AS k FROM rs) SELECT file, CAST(greatest(2, floor(floor(width * k + 1e-9) / 2) * 2) AS BIGINT) AS target_width,
  CAST(greatest(2, floor(floor(height * k + 1e-9) / 2) * 2) AS BIGINT) AS target_height, CASE WHEN fps > 30 THEN 24.0e0 ELSE fps END AS target_fps,
  concat_ws(',', CASE WHEN reasons <> '' THEN reasons END, CASE WHEN fps > 30 THEN 'frame_rate' END) AS reasons FROM t""")
def transcode_targets(spark, sf_dir):
    c = F.col
    w, h = md.target_size(c("width"), c("height"))
    reasons = md.profile_reasons(c("hdr"), c("gib"), c("width"), c("height"), c("depth"), c("codec"), c("fps"))
    return media_files(spark, sf_dir).select("file", w.alias("target_width"), h.alias("target_height"), md.target_fps(c("fps")).alias("target_fps"), F.array_join(reasons, ",").alias("reasons"))


@query(f"WITH {_FILES} SELECT folder, CASE WHEN hdr THEN 'HDR_TONEMAP' WHEN gib > 4.5 THEN 'OVERSIZE' WHEN reasons <> '' THEN 'TRANSCODE' ELSE 'PASS' END AS class, count(*) AS files, round(sum(gib), 1) AS gib, count(*) FILTER (WHERE hdr) AS hdr_files FROM rs GROUP BY ALL")
def media_inventory_summary(spark, sf_dir):
    return media_files(spark, sf_dir).groupBy("folder", md.inventory_class(_reasons()).alias("class")).agg(F.count("*").alias("files"), F.round(F.sum("gib"), 1).alias("gib"), F.count_if("hdr").alias("hdr_files"))


@query(f"""WITH {_FILES}, k AS (SELECT *, row_number() OVER w AS k, lead(minutes) OVER w AS second FROM x WHERE minutes >= 40 WINDOW w AS (PARTITION BY folder ORDER BY minutes DESC, file)),
g AS (SELECT folder, CASE WHEN coalesce(second >= 0.9 * minutes, false) THEN NULL ELSE file END AS "primary", CASE WHEN coalesce(second >= 0.9 * minutes, false) THEN 'ambiguous' ELSE 'high' END AS confidence FROM k WHERE k = 1)
SELECT d.folder, "primary", coalesce(confidence, 'none') AS confidence FROM (SELECT DISTINCT folder FROM x) d LEFT JOIN g USING (folder)""")
def primary_choice(spark, sf_dir):
    return mo.primary_video(media_files(spark, sf_dir), name="file")


@query(f"WITH {_FILES} SELECT file, printf('p%d.%dx%d.%sfps.%s.%dbit.%s.mkv', file, width, height, regexp_replace(printf('%.3f', fps), '\\.?0+$', ''), codec, depth, CASE WHEN hdr THEN 'hdr' ELSE 'sdr' END) AS name FROM x")
def canonical_names(spark, sf_dir):
    c = F.col
    key = F.concat(F.lit("p"), c("file").cast("string"))
    return media_files(spark, sf_dir).select("file", md.canonical_name(key, c("width"), c("height"), c("fps"), c("codec"), c("depth"), c("hdr"), F.lit(".mkv")).alias("name"))


@query("""WITH i AS (SELECT o_custkey AS key, o_orderkey AS version, o_orderstatus AS status FROM orders WHERE o_orderkey % 2 = 0), c AS (SELECT o_custkey AS key, o_orderkey AS version, o_orderstatus AS status FROM orders WHERE o_orderkey % 2 = 1),
u AS (SELECT * FROM i UNION ALL SELECT * FROM c) SELECT key, max(version) AS version, arg_max(status, version) AS status FROM u GROUP BY key""")
def upsert_index(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("status"))
    return mo.upsert_latest(o.where("version % 2 = 0"), o.where("version % 2 = 1"), "key", "version")


@query("""WITH n AS (SELECT o_orderpriority AS p, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY ALL) SELECT p AS o_orderpriority, string_agg(s || '=' || n, ';' ORDER BY s || '=' || n) AS counts FROM n GROUP BY p""")
def group_count_map(spark, sf_dir):
    m = mo.count_map(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")
    return m.withColumn("counts", F.array_join("counts", ";"))


@query("""WITH p AS (SELECT DISTINCT CASE WHEN page_id % 3 = 0 THEN '/other/' || page_id ELSE '/' || replace(split_part(split_part(url, '?', 1), '#', 1), '://', '/') END AS path FROM pages)
SELECT path, CASE WHEN starts_with(path, '/http/') THEN '/plain' || substr(path, 6) WHEN starts_with(path, '/https/') THEN '/tls' || substr(path, 7) ELSE path END AS resolved FROM p""")
def path_rewrite(spark, sf_dir):
    """Sources end at folder borders: /https does not rewrite /httpsx, and of two the longer wins."""
    of_url = F.concat(F.lit("/"), F.replace(F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)), F.lit("://"), F.lit("/")))
    path = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/other/"), F.col("page_id").cast("string"))).otherwise(of_url)
    paths = table(spark, sf_dir, "pages").select(path.alias("path")).distinct()
    prefixes = spark.createDataFrame([("/http", "/plain"), ("/https", "/tls"), ("/https/m", "/never"), ("/oth", "/never")], "source string, target string")
    return mo.longest_prefix(paths, prefixes)


# A label is a gold decision; a rule on the text is the prediction, and a fifth of the documents has none.
_GOLD = """g AS (SELECT doc_id, CASE WHEN quality = 1 THEN CASE WHEN toxic = 1 THEN 'uncertain' ELSE 'match' END ELSE 'no_match' END AS expected FROM labels),
p AS (SELECT doc_id, lang, CASE WHEN n_chars < 400 THEN 'no_match' WHEN n_chars % 7 = 0 THEN 'uncertain' ELSE 'match' END AS actual FROM documents WHERE doc_id % 5 <> 0),
j AS (SELECT g.doc_id, expected, coalesce(actual, 'missing') AS actual, coalesce(p.lang, 'none') AS lang FROM g LEFT JOIN p USING (doc_id))"""


def judged(spark, sf_dir):
    gold = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, F.when(F.col("toxic") == 1, "uncertain").otherwise("match")).otherwise("no_match").alias("decision"))
    docs = table(spark, sf_dir, "documents").where("doc_id % 5 <> 0")
    pred = docs.select("doc_id", "lang", F.when(F.col("n_chars") < 400, "no_match").when(F.col("n_chars") % 7 == 0, "uncertain").otherwise("match").alias("guess"))
    rows = ev.with_predictions(gold, pred, ["doc_id"], "decision", "guess")
    return rows.join(pred.select("doc_id", "lang"), "doc_id", "left").withColumn("lang", F.coalesce("lang", F.lit("none")))


_VALUES = ["match", "no_match", "uncertain"]


@query(f"""WITH {_GOLD} SELECT e.expected, count(*) FILTER (WHERE actual = 'match') AS "match", count(*) FILTER (WHERE actual = 'no_match') AS no_match, count(*) FILTER (WHERE actual = 'uncertain') AS uncertain,
  count(*) FILTER (WHERE actual = 'missing') AS missing FROM (SELECT unnest(['match', 'no_match', 'uncertain']) AS expected) e LEFT JOIN j USING (expected) GROUP BY e.expected""")
def confusion_matrix(spark, sf_dir):
    return ev.confusion(judged(spark, sf_dir), _VALUES, [*_VALUES, "missing"])


_METRICS = f"""{_GOLD}, m AS (SELECT count(*) AS n, round(avg(CASE WHEN expected = actual THEN 1.0e0 ELSE 0 END), 6) AS accuracy,
  round(count(*) FILTER (WHERE expected = 'match' AND actual = 'match') / count(*) FILTER (WHERE actual = 'match'), 6) AS precision,
  round(count(*) FILTER (WHERE expected = 'match' AND actual = 'match') / count(*) FILTER (WHERE expected = 'match'), 6) AS recall FROM j)"""


def _metrics(spark, sf_dir):
    m = ev.binary_metrics(judged(spark, sf_dir), "match")
    return m.select("n", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall")])


@query(f"WITH {_METRICS} SELECT * FROM m")
def binary_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir)


@query(f"WITH {_METRICS} SELECT *, accuracy >= 0.5 AS accuracy_ok, precision >= 0.9 AS precision_ok, recall >= 0.6 AS recall_ok, accuracy >= 0.5 AND precision >= 0.9 AND recall >= 0.6 AS passed FROM m")
def acceptance_gates(spark, sf_dir):
    return ev.gates(_metrics(spark, sf_dir), {"accuracy": 0.5, "precision": 0.9, "recall": 0.6})


_STRATA = f"{_GOLD}, st AS (SELECT lang, count(*) AS n, avg(CASE WHEN expected = actual THEN 1.0e0 ELSE 0 END) AS accuracy FROM j GROUP BY lang)"


@query(f"WITH {_STRATA} SELECT lang, n, round(accuracy, 6) AS accuracy FROM st")
def stratified_accuracy(spark, sf_dir):
    return ev.stratified(judged(spark, sf_dir), "lang").withColumn("accuracy", F.round("accuracy", 6))


@query(f"WITH {_STRATA}, w AS (SELECT lang, count(*) AS weight FROM documents GROUP BY lang) SELECT round(sum(accuracy * weight) / sum(weight), 6) AS weighted_accuracy FROM st JOIN w USING (lang)")
def source_weighted_accuracy(spark, sf_dir):
    weights = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("weight"))
    m = ev.weighted_mean(ev.stratified(judged(spark, sf_dir), "lang"), weights, "lang")
    return m.select(F.round("weighted_accuracy", 6).alias("weighted_accuracy"))


@query("""SELECT (SELECT count(*) FROM documents) AS whole, (SELECT count(*) FROM labels) AS part, (SELECT count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)) AS rest,
  (SELECT count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE l.doc_id = d.doc_id)) AS "foreign", (SELECT count(*) FROM documents) = (SELECT count(*) FROM labels) + (SELECT count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)) AS exact""")
def partition_disjoint_complete(spark, sf_dir):
    return ev.partition_report(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@query("""WITH q AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 3 = 0), r AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderkey % 3 = 1 GROUP BY 1)
SELECT * FROM (SELECT coalesce(q.k, r.k) AS k, CASE WHEN n IS NULL THEN 'missing' WHEN q.k IS NULL THEN 'foreign' WHEN n > 1 THEN 'duplicate' END AS problem FROM q FULL JOIN r ON q.k = r.k) WHERE problem IS NOT NULL""")
def missing_foreign_keys(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    return ev.coverage(o.where("o_orderkey % 3 = 0"), o.where("o_orderkey % 3 = 1"), ["k"])


@query("SELECT c_custkey, c_mktsegment FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'P') AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderpriority = '1-URGENT')")
def semi_excluded(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    semi = c.join(o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    return semi.join(o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("""SELECT d.doc_id, CASE WHEN d.doc_id % 11 = 0 THEN 'xx' ELSE d.lang END AS lang, CASE WHEN d.doc_id % 22 = 0 THEN 'patched' ELSE d.source END AS source, d.doc_id % 11 = 0 AS patched FROM documents d""")
def overlay_corrections(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    patch = d.where("doc_id % 11 = 0").select("doc_id", F.lit("xx").alias("lang"), F.when(F.col("doc_id") % 22 == 0, "patched").alias("source"))
    return ev.overlay(d, patch, ["doc_id"], ["lang", "source"])


@query("""WITH l AS (SELECT * FROM lineitem), c AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM l GROUP BY ALL) 
SELECT 'line_unique' AS rule, l_orderkey || ':' || l_linenumber AS key, 'repeated ' || n || ' times' AS message FROM c WHERE n > 1
UNION ALL SELECT 'late_discount', CAST(l_orderkey AS VARCHAR), 'discount ' || printf('%.2f', l_discount) FROM l WHERE l_discount >= 0.1 AND l_quantity > 45
UNION ALL SELECT 'tax_of_return', CAST(l_orderkey AS VARCHAR), 'tax ' || printf('%.2f', l_tax) FROM l WHERE l_returnflag = 'R' AND l_tax >= 0.08
UNION ALL SELECT 'customer_known', CAST(o_custkey AS VARCHAR), 'unknown, ' || count(*) || ' rows' FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey) GROUP BY o_custkey""")
def constraint_violations(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rules = {
        "late_discount": ((F.col("l_discount") >= 0.1) & (F.col("l_quantity") > 45), F.format_string("discount %.2f", "l_discount")),
        "tax_of_return": ((F.col("l_returnflag") == "R") & (F.col("l_tax") >= 0.08), F.format_string("tax %.2f", "l_tax")),
    }
    return ct.violations(
        ct.unique(li, "line_unique", ["l_orderkey", "l_linenumber"]),
        ct.row_rules(li, F.col("l_orderkey"), rules),
        ct.references(table(spark, sf_dir, "orders"), "customer_known", "o_custkey", table(spark, sf_dir, "customer"), "c_custkey"),
    )


@query("""WITH s AS (SELECT user_id, CAST(row_number() OVER w AS BIGINT) AS shot, event_id AS a, lead(event_id - event_id % 3) OVER w AS b FROM events WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
l AS (SELECT *, lag(b) OVER (PARTITION BY user_id ORDER BY shot) AS p FROM s WHERE b IS NOT NULL) SELECT 'shots_contiguous' AS rule, user_id || ':' || shot AS key, CASE WHEN a > p THEN 'gap' ELSE 'overlap' END AS message FROM l WHERE a <> p""")
def range_violations(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    s = e.select("user_id", F.row_number().over(w).alias("shot"), F.col("event_id").alias("a"), F.lead(F.expr("event_id - event_id % 3")).over(w).alias("b")).where("b IS NOT NULL")
    return ct.contiguous(s, "shots_contiguous", "user_id", "shot", "a", "b")


@query()
def pilot_selection(spark, sf_dir):
    """Sixty documents with a quota for each language, one of each source in turn."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return stratified_pilot(d, "lang", "source", ["doc_id"], 60)


# Vectors of label 0 are the target's faces, others are known not to be.
_VEC = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings), u AS (SELECT vec_id, label, list_transform(x, lambda e: e / sqrt(list_dot_product(x, x))) AS x FROM v)"""


@query(f"""WITH {_VEC}, s AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_dot_product(q.x, c.x), 9) AS cosine FROM u q JOIN u c ON q.vec_id <> c.vec_id AND c.label = 0 WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM s) SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, cosine FROM r WHERE rank <= 3""")
def knn_cosine(spark, sf_dir):
    u = vf.normalized(table(spark, sf_dir, "embeddings"), "embedding")
    return vf.gallery_top_k(u.where("vec_id % 20 = 0"), u.where("label = 0"), "vec_id", 3).select("query_id", "rank", "vec_id", F.round("cosine", 9).alias("cosine"))


_LOO = f"""{_VEC}, g AS (SELECT * FROM u WHERE label = 0), pp AS (SELECT a.vec_id, max(list_dot_product(a.x, b.x)) AS m FROM g a JOIN g b ON a.vec_id <> b.vec_id GROUP BY 1),
ng AS (SELECT a.vec_id, max(list_dot_product(a.x, b.x)) AS m FROM g a JOIN u b ON b.label = 1 GROUP BY 1)"""


@query(f"""WITH {_LOO} SELECT round((SELECT min(m) FROM pp), 6) AS threshold, round((SELECT min(pp.m - ng.m) FROM pp JOIN ng USING (vec_id)), 6) AS least_margin, (SELECT count(*) FROM g) AS gallery""")
def loo_calibration(spark, sf_dir):
    u = vf.normalized(table(spark, sf_dir, "embeddings"), "embedding")
    c = vf.calibrate(u.where("label = 0"), u.where("label = 1"), "vec_id")
    return c.select(F.round("threshold", 6).alias("threshold"), F.round("least_margin", 6).alias("least_margin"), "gallery")


@query(f"""WITH {_VEC}, q AS (SELECT * FROM u WHERE label <> 0), s AS (SELECT q.vec_id, q.label, max(list_dot_product(q.x, g.x)) AS m FROM q JOIN u g ON g.label = 0 GROUP BY ALL)
SELECT label, CASE WHEN count(*) FILTER (WHERE m >= 0.4) >= 2 THEN 'verified' WHEN count(*) FILTER (WHERE m >= 0.4) = 1 OR count(*) FILTER (WHERE abs(m - 0.4) <= 0.03) > 0 OR count(*) < 2 THEN 'uncertain' ELSE 'not_verified' END AS decision, count(*) AS usable FROM s GROUP BY label""")
def verify_decision(spark, sf_dir):
    """A label is a shot, its vectors are its faces."""
    u = vf.normalized(table(spark, sf_dir, "embeddings"), "embedding")
    best = vf.best_similarity(u.where("label <> 0"), u.where("label = 0"), "vec_id", ["label"])
    return vf.decide(best, "label", threshold=0.4, near=0.03)
