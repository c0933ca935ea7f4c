"""Folds and cuts of ordered rows."""

from sceneline.operators import sequences as sq


def test_events_are_cut_as_they_stream_by(spark):
    """Cuts as of the plain rule; events come in no order, nulls are a key, no grouped map."""
    rows = [(k, e, i, 10.0 * i, 10.0 * i + 8, (i * 7 % 5) / 5) for k in ("a", None) for e in (1, 2**60 + 1) for i in (4, 2, 0, 3, 1)]
    events = spark.createDataFrame(rows, "k string, e long, index long, start double, end double, score double")
    got = sq.split_long(events, ["k", "e"], 30.0)
    parts = {}
    for r in got.collect():
        parts.setdefault((r["k"], r["e"]), {})[r["index"]] = r["part"]
    # scores 0, 0.4, 0.8, 0.2, 0.6: the first cut is where the smaller neighbour is 0, then at 0.2 nearest the middle
    assert parts == {(k, e): {0: 0, 1: 1, 2: 1, 3: 2, 4: 2} for k in ("a", None) for e in (1, 2**60 + 1)}
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()
