"""Round trips: what the sinks write is what the sources read; subtitle texts; streams against batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from sceneline.operators import subtitles as sb
from sceneline.plans.analogs import table
from sceneline.sources import files, sinks
from sceneline.sources import merge as mg
from sceneline.sources.scratch import scratch_path
from sceneline.streaming import sessions

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, CAST(p_size AS VARCHAR) AS p_size FROM part")
def csv_round_trip(spark, sf_dir):
    """Written with a header and declared columns, read with a contract on them."""
    path = scratch_path(spark, "csv")
    sinks.write_csv(table(spark, sf_dir, "part"), path, ["p_partkey", "p_name", "p_size"])
    return files.csv_with_columns(spark, path, ["p_partkey", "p_name", "p_size"])


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def jsonl_round_trip(spark, sf_dir):
    """Written once with a guard against NaN, read strictly."""
    path = scratch_path(spark, "json")
    sinks.write_once_json(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return files.strict_jsonl(spark, path, "c_custkey long, c_name string, c_acctbal double")


@query("""WITH g AS (SELECT *, CASE WHEN s_suppkey % 3 = 0 THEN '{"s_suppkey": ' || s_suppkey || ', "bad' WHEN s_suppkey % 7 = 0 THEN '' ELSE 'good' END AS kind FROM supplier) SELECT s_suppkey, s_name FROM g WHERE kind = 'good'""")
def checked_jsonl_rows(spark, sf_dir):
    """Of lines of which some are cut off and some blank, the good ones."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    whole = F.to_json(F.struct(k.cast("long").alias("s_suppkey"), "s_name"))
    line = F.when(k % 3 == 0, F.concat(F.lit('{"s_suppkey": '), k.cast("string"), F.lit(', "bad'))).when(k % 7 == 0, "").otherwise(whole)
    path = scratch_path(spark, "lines")
    s.select(line.alias("value")).write.text(path)
    from pyspark.sql import types as T

    good, _ = files.checked_jsonl(spark, path, T.StructType([T.StructField("s_suppkey", T.LongType()), T.StructField("s_name", T.StringType())]))
    return good


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 1")
def append_once(spark, sf_dir):
    """Appended twice with rows in common: each key is there once."""
    o, path = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), scratch_path(spark, "append")
    sinks.append_new(o.where("o_orderkey % 3 = 0"), path, ["o_orderkey"])
    sinks.append_new(o.where("o_orderkey % 3 <> 1"), path, ["o_orderkey"])
    return spark.read.parquet(path)


@query("""SELECT CAST(conv_id AS VARCHAR) AS path, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS cue, CAST(turn * 5 AS DOUBLE) AS start_sec, turn * 5 + 4.5e0 AS end_sec, 'L ' || trim(regexp_replace(text, '\\s+', ' ', 'g')) AS original_text FROM conversations""".replace("\\\\", "\\"))
def subtitle_cues(spark, sf_dir):
    """Subtitle files made of conversations, read cue by cue."""
    c, t = table(spark, sf_dir, "conversations"), F.col("turn")
    clock = lambda s, ms: F.format_string("00:%02d:%02d,%03d", F.floor(s / 60), s % 60, F.lit(ms))
    cue = F.concat((t + 1).cast("string"), F.lit("\n"), clock(t * 5, 0), F.lit(" --> "), clock(t * 5 + 4, 500), F.lit("\nL "), F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit("\n\n"))
    whole = c.select("conv_id", "turn", cue.alias("cue")).groupBy(F.col("conv_id").cast("string").alias("path")).agg(F.array_sort(F.collect_list(F.struct("turn", "cue"))).alias("l"))
    return sb.cues(whole.select("path", F.array_join(F.transform("l", lambda x: x["cue"]), "").alias("value")))


@query("""WITH r AS (SELECT *, row_number() OVER w AS rn, sum(CASE WHEN value > 60 THEN 0 ELSE 1 END) OVER w AS g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
m AS (SELECT user_id, max(g) AS last FROM r GROUP BY 1) SELECT user_id, arg_min(event_id, rn) AS first_event, arg_min(event_id, (-value, rn)) AS apex_event, max(value) AS apex, count(*) AS length FROM r JOIN m USING (user_id) WHERE value > 60 AND g < last GROUP BY user_id, g""")
def streamed_runs(spark, sf_dir):
    """Runs above a threshold from a stream with keyed state, all that is there in one go."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out, state = scratch_path(spark, "runs"), scratch_path(spark, "runs-state")
    run = sessions.runs_above(stream, 60.0).writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
    run.awaitTermination()
    return spark.read.schema(sessions.RUN).parquet(out)


_CHANGE = "CASE WHEN o_orderkey % 96 = 3 THEN 'delete' WHEN o_orderkey % 48 = 5 THEN 'upsert' END"


@query(f"""WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, {_CHANGE} AS op FROM orders)
SELECT o_orderkey, o_custkey, CASE WHEN op = 'upsert' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN op = 'upsert' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 16 IN (3, 5) THEN 2 ELSE 1 END AS version FROM o WHERE op IS DISTINCT FROM 'delete'
UNION ALL SELECT -o_orderkey * 16 + 5, o_custkey, 'N', o_totalprice, 2 FROM o WHERE op = 'delete'""")
def merged_orders(spark, sf_dir):
    """Updates, deletes and new rows merged into a table of sixteen partitions, of which two are rewritten."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    path, part = scratch_path(spark, "orders"), F.pmod("o_orderkey", F.lit(16))
    mg.create(o, path, part)
    op = F.expr(_CHANGE)
    new = o.where(op == "delete").select((-F.col("o_orderkey") * 16 + 5).alias("o_orderkey"), "o_custkey", F.lit("N").alias("o_orderstatus"), "o_totalprice", F.lit("upsert").alias("op"))
    old = o.withColumn("op", op).where("op IS NOT NULL").withColumns({"o_orderstatus": F.when(F.col("op") == "upsert", "X").otherwise(F.col("o_orderstatus")), "o_totalprice": F.when(F.col("op") == "upsert", F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice"))})
    mg.merge(old.unionByName(new), path, ["o_orderkey"], part, 1)
    return mg.read(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in o.schema)).drop("part")
