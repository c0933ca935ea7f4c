"""Relational queries over the star schema: aggregates, windows, sets, joins, time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

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


def cents(col: str):
    """Money as whole cents: sums do not depend on the order of rows."""
    return F.sum(F.rint(F.col(col) * 100).cast("long"))


_C = "CAST(sum(CAST(round({0} * 100) AS BIGINT)) AS BIGINT)"


@query(f"SELECT l_returnflag, l_linestatus, count(*) AS n, {_C.format('l_quantity')} AS quantity, {_C.format('l_extendedprice')} AS price, count(*) FILTER (WHERE l_discount > 0.05) AS discounted, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL")
def pricing_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP '2000-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), cents("l_quantity").alias("quantity"), cents("l_extendedprice").alias("price"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship")
    )


@query(f"SELECT o_orderstatus, o_orderpriority, count(*) AS n, {_C.format('o_totalprice')} AS total, CAST(GROUPING(o_orderstatus) * 2 + GROUPING(o_orderpriority) AS BIGINT) AS gid FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), cents("o_totalprice").alias("total"), F.grouping_id().cast("long").alias("gid"))


@query("SELECT r_name, n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup_customers(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.rollup("r_name", "n_name").agg(F.count("*").alias("customers"))


@query("SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), ())")
def grouping_sets_parts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.groupingSets([[F.col("p_brand")], [F.col("p_type")], []], "p_brand", "p_type").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_mktsegment, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER w AS quartile, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey)")
def rank_family(spark, sf_dir):
    w = Window.partitionBy("c_mktsegment").orderBy("c_acctbal", "c_custkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", "c_mktsegment", F.row_number().over(w).alias("rn"), F.rank().over(w).alias("rk"), F.dense_rank().over(w).alias("dr"), F.ntile(4).over(w).alias("quartile"), F.round(F.percent_rank().over(w), 6).alias("pr"), F.round(F.cume_dist().over(w), 6).alias("cd")
    )


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS in_a_day, round(max(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW), 4) AS most FROM events")
def range_frames(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-86400000000, 0)
    return table(spark, sf_dir, "events").select("event_id", F.count("*").over(w).alias("in_a_day"), F.round(F.max("value").over(w), 4).alias("most"))


@query("SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) WHERE k <= 3")
def top_per_group(spark, sf_dir):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, sf_dir, "part").withColumn("k", F.row_number().over(w)).where("k <= 3").select("p_brand", "p_partkey", "p_retailprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


@query("WITH a AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'), r AS (SELECT 'union' AS op, k FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersect', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'except', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'except_all', k FROM (SELECT k FROM a EXCEPT ALL SELECT k FROM b)) SELECT op, k FROM r")
def set_operations(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a, b = (o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")) for s in "FO")
    named = lambda op, d: d.select(F.lit(op).alias("op"), "k")
    return named("union", a.union(b).distinct()).union(named("intersect", a.intersect(b))).union(named("except", a.subtract(b))).union(named("except_all", a.exceptAll(b)))


@query("SELECT c.c_custkey, count(o_orderkey) AS orders FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY ALL")
def left_join_counts(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return c.join(o, "c_custkey", "left").na.fill(0, ["orders"])


@query("SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000")
def right_join(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 5000")
    return s.join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "right").select("s_suppkey", "n_name")


@query(f"SELECT n_name, CAST(sum(CAST(round(l_extendedprice * (1 - l_discount) * 10000) AS BIGINT)) AS BIGINT) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE c_nationkey = s_nationkey AND o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY n_name")
def local_supplier_revenue(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    o = table(spark, sf_dir, "orders").where("o_orderdate >= TIMESTAMP '1996-01-01'").select("o_orderkey", "o_custkey")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.where("c_nationkey = s_nationkey").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.sum(F.rint(F.col("net") * 10000).cast("long")).alias("revenue"))


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def tumbling_window(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
    return e.select("event_type", F.col("w.start").alias("day"), "n", "users")


@query("WITH b AS (SELECT event_type, ts, unnest([0, 1]) AS k FROM events) SELECT event_type, time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR * k AS start, count(*) AS n FROM b GROUP BY ALL")
def sliding_window_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 day", "12 hours").alias("w")).agg(F.count("*").alias("n"))
    return e.select("event_type", F.col("w.start").alias("start"), "n")


@query("WITH g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, s")
def session_window_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return e.select("user_id", F.col("w.start").alias("start"), "last", "n")


@query("SELECT a.event_id, a.ts, b.event_id AS purchase FROM events a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND a.ts >= b.ts WHERE a.event_type = 'error'")
def as_of_join(spark, sf_dir):
    """The last purchase up to an error: both sides in one ordered window, no join at all."""
    w = Window.partitionBy("user_id").orderBy("ts", F.col("event_type") == "error").rowsBetween(Window.unboundedPreceding, 0)
    e = table(spark, sf_dir, "events").where("event_type IN ('error', 'purchase')")
    return e.withColumn("purchase", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), True).over(w)).where("event_type = 'error'").select("event_id", "ts", "purchase")


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"O\", count(*) FILTER (WHERE o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1")
def pivot_status(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0, ["F", "O", "P"])


@query("SELECT c_custkey, unnest(['a', 'b']) AS name, unnest([c_acctbal, CAST(c_nationkey AS DOUBLE)]) AS value FROM customer")
def unpivot_customer(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("a"), F.col("c_nationkey").cast("double").alias("b"))
    return c.unpivot("c_custkey", ["a", "b"], "name", "value")


@query("SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY 1")
def json_field_sum(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.from_json("props", "k long")["k"]).alias("k"))


@query()
def approximate_sketches(spark, sf_dir):
    """Distinct users and quantiles by sketches of fixed size."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"), F.percentile_approx("value", [0.5, 0.9], 1000).alias("quantiles"))


@query("SELECT event_type, quantile_cont(value, 0.01) AS p1, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.99) AS p99, round(stddev_pop(value), 6) AS std, round(avg(CASE WHEN value <= 1 THEN 1.0e0 ELSE 0 END), 6) AS low_share, round(avg(CASE WHEN value >= 150 THEN 1.0e0 ELSE 0 END), 6) AS high_share FROM events GROUP BY 1".replace("quantile_cont(value, 0.01)", "round(quantile_cont(value, 0.01), 6)").replace("quantile_cont(value, 0.5)", "round(quantile_cont(value, 0.5), 6)").replace("quantile_cont(value, 0.99)", "round(quantile_cont(value, 0.99), 6)"))
def value_percentiles(spark, sf_dir):
    """Exact percentiles and clip shares, as of a frame's brightness."""
    p = lambda q: F.round(F.percentile("value", q), 6)
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        p(0.01).alias("p1"), p(0.5).alias("p50"), p(0.99).alias("p99"), F.round(F.stddev_pop("value"), 6).alias("std"), share(F.col("value") <= 1).alias("low_share"), share(F.col("value") >= 150).alias("high_share")
    )


@query("SELECT doc_id, sha256(text) AS digest, length(text) AS n FROM documents")
def content_digests(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.length("text").cast("long").alias("n"))
