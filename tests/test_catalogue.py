"""Every query with SQL gives DuckDB's rows on the small tables; the others have tests of their own."""

import os
import re

import duckdb
import pytest

from sceneline.functions import text as tx
from sceneline.operators import sequences as sq
from sceneline.plans import catalogue, script_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: "null" if v is None else repr(round(v, 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    want = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert canonical(df.columns, df.collect()) == canonical(want.columns, want.fetchall())

def plain_pilot(rows, target):
    cells = {}
    for doc, cell, bucket in rows:
        cells.setdefault(cell, {}).setdefault(bucket, []).append(doc)
    quota = sq.proportional_quotas({c: sum(map(len, b.values())) for c, b in sorted(cells.items())}, target)
    out = set()
    for c, n in quota.items():
        turns = sorted((i, b, d) for b, docs in cells[c].items() for i, d in enumerate(sorted(docs)))
        out |= {d for _, _, d in turns[:n]}
    return out


def test_pilot_selection(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "source").where("lang IS NOT NULL AND source IS NOT NULL").collect()]
    got = catalogue.QUERIES["pilot_selection"](spark, SF).where("lang IS NOT NULL AND source IS NOT NULL")
    assert {r["doc_id"] for r in got.collect()} == plain_pilot(rows, 60)


def test_approximate_sketches(spark):
    got = {r["event_type"]: r for r in catalogue.QUERIES["approximate_sketches"](spark, SF).collect()}
    exact = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").select("event_type", "user_id", "value").collect():
        exact.setdefault(r["event_type"], []).append((r["user_id"], r["value"]))
    assert set(got) == set(exact)
    for kind, rows in exact.items():
        users, values = len({u for u, _ in rows}), sorted(v for _, v in rows)
        assert abs(got[kind]["users"] - users) <= 0.15 * users + 1
        for q, v in zip((0.5, 0.9), got[kind]["quantiles"], strict=True):
            low, high = sum(x < v for x in values) / len(values), sum(x <= v for x in values) / len(values)
            assert low - 0.01 <= q <= high + 0.01


def test_fuzzy_best_block(spark):
    words = lambda t: [w.lower() for w in re.findall(r"\w+(?:'\w+)?", t.replace("’", "'"))]
    items = {r["item_id"]: words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    turns = {r["conv_id"] * 100 + r["turn"]: words(r["text"]) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    got = {r["item_id"]: (r["block"], r["fuzzy"]) for r in catalogue.QUERIES["fuzzy_best_block"](spark, SF).collect()}
    assert got == {item: (-m[1], m[0]) for item, a in items.items() for m in [max((round(tx.fuzzy(a, b), 6), -block) for block, b in turns.items())]}


def test_split_long_events(spark):
    """Every event keeps its rows; no part is above the limit but single rows; parts are runs; cuts are where they should be."""
    rows = {}
    for r in catalogue.QUERIES["split_long_events"](spark, SF).collect():
        rows.setdefault((r["movie_key"], r["event"]), []).append((r["index"], r["start"], r["end"], r["score"], r["part"]))

    def cut(own):
        if max(r[2] for r in own) - own[0][1] <= 864000.0 or len(own) == 1:
            return [own]
        middle = (own[0][1] + own[-1][2]) / 2
        at = min(range(1, len(own)), key=lambda i: (min(own[i - 1][3], own[i][3]), abs(own[i][1] - middle), i))
        return cut(own[:at]) + cut(own[at:])

    assert rows
    for own in rows.values():
        own.sort()
        assert [r[4] for r in own] == [k for k, part in enumerate(cut(own)) for _ in part]


#: Queries without SQL, and the test that has a plain version of each.
TESTED = {"high_risk_audit", "high_risk_summary", "outside_matches", "composite_audit", "composite_audit_summary", "calibration_errors", "review_requests", "review_candidates", "script_rescue_v2", "script_rescue_v3", "script_rescue_v4", "rescued_requests", "pilot_selection", "approximate_sketches", "fuzzy_best_block", "split_long_events", "cursor_retrieval", "align_lines"}


def test_all_queries_are_tested(spark):
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) == TESTED
    got = catalogue.QUERIES["align_lines"](spark, SF)
    lines = script_queries.script(spark, SF)[0]
    assert got.count() == lines.count() and got.where("status = 'auto_aligned'").count() > 0.5 * lines.count()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.HAS_LLM == os.path.isdir(os.path.join(os.path.dirname(entry.__file__), "sceneline", "llm"))


def test_quotas():
    assert sq.proportional_quotas({"a": 70, "b": 20, "c": 10}, 10) == {"a": 7, "b": 2, "c": 1}
    assert sq.proportional_quotas({"a": 98, "b": 1, "c": 1}, 10) == {"a": 8, "b": 1, "c": 1}
    assert sq.proportional_quotas({"a": 1, "b": 0, "c": 5}, 20) == {"a": 1, "c": 5}
    assert sq.proportional_quotas({}, 5) == {}
    assert sum(sq.proportional_quotas({str(i): i * i for i in range(9)}, 30).values()) == 30


def test_split_long(spark):
    rows = [("m", 0, i, float(i * 10), float(i * 10 + 10), s) for i, s in enumerate([0.9, 0.2, 0.8, 0.1, 0.7, 0.6, 0.9])]
    events = spark.createDataFrame(rows, "movie_key string, event long, index long, start double, end double, score double")
    got = {r["index"]: r["part"] for r in sq.split_long(events, ["movie_key", "event"], 30.0).collect()}
    # Of 70 s: cuts of least neighbouring score are before and after index 3; the one nearer the middle (35 s) is at 30 s.
    assert len(set(got.values())) >= 3
    for part in set(got.values()):
        own = [i for i, p in got.items() if p == part]
        assert max(own) - min(own) + 1 == len(own) <= 3


def test_plans(spark):
    """No nested loops in the interval join; filters and columns reach the scan."""
    plan = catalogue.QUERIES["interval_overlap_join"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    plan = catalogue.QUERIES["pricing_summary"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan and "l_tax" not in plan
