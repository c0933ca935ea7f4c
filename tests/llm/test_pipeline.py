"""The pipeline, stage by stage, against plain versions of what a stage decides."""

import re
import sys
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sceneline.llm import bpe, jaccard, mixing
from tests.llm.test_jaccard import brute
from tests.llm.test_pii import base

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline as cp  # noqa: E402


def plain_redact(text):
    out, at = [], 0
    secrets = [("secret", *m.span()) for m in re.finditer("(?<![0-9a-z])[0-9a-f]{40}(?![0-9a-z])", text or "")]
    for a, _, b, kind in sorted((a, -b, b, k) for k, a, b in base(text or "") + secrets):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + (text or "")[at:]


def test_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    assert [n for n, _ in cp.STAGES] == ["language ID", "n-gram Jaccard join", "PII", "mixing sources to target weights", "BPE encoding and decoding"]
    f = dict(cp.STAGES)

    one = f["language ID"](spark, docs, "").cache()
    assert one.schema.names == docs.schema.names
    kept = {r["doc_id"]: r["text"] for r in one.collect()}
    assert len(kept) >= 0.98 * len(rows) and all(kept[d] == rows[d]["text"] for d in kept)

    two = f["n-gram Jaccard join"](spark, one, "").cache()
    classes = brute(sorted(kept.items()), 5, 80, 100)
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(d for d, _, c in classes if d == c)

    secret = lambda d: F.left(F.sha2(d.cast("string").cast("binary"), 256), F.lit(40))
    told = F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit(' token = "'), secret(F.col("doc_id")), F.lit('" end'))).otherwise(F.col("text"))
    two = two.withColumn("text", told).cache()
    three = f["PII"](spark, two, "").cache()
    assert three.where("text LIKE '%[SECRET]\" end'").count() == two.where("doc_id % 9 = 0").count() > 5
    assert {r["doc_id"]: r["text"] for r in three.collect()} == {r["doc_id"]: plain_redact(r["text"]) for r in two.collect()}
    assert all(r["n_chars"] == len(r["text"]) for r in three.collect())

    four = f["mixing sources to target weights"](spark, three, "").cache()
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(three).collect()}
    words = {}
    for r in four.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
    assert words == {d: n for d, n in taken.items() if n}

    five = f["BPE encoding and decoding"](spark, four, "").collect()
    library = Tokenizer.from_file(bpe.default_path())
    want = sorted((r["doc_id"], tuple(library.encode(r["text"], add_special_tokens=False).ids)) for r in four.collect())
    assert sorted((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in five) == want
    assert jaccard.join_components(two, 5, 80, 100).where("component_id <> doc_id").count() == 0


def test_clashing_names_and_odd_rows(spark):
    """All stages but the last keep all columns, whatever their names, and take nulls, empty texts and repeated rows."""
    own = ["_row", "_dropped", "_spans", "_size", "_sk", "row", "key", "node", "target", "source_size", "draws", "draw", "cuts", "last", "component_id", "text_key"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in docs]
    rows += [rows[0], rows[0], (None, rows[1][1], None, None, None), (9001, None, None, None, None), (9002, "", "en", "x", 0), (9003, " 12 ", "en", "x", 4)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in own)
    first = spark.createDataFrame([(*r, *[f"{n}:{r[0]}" for n in own]) for r in rows], schema)
    for given in (first, first.limit(0)):
        out = given
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, out, "").cache()
            assert out.schema.names == first.schema.names
            assert all(r[n] == f"{n}:{r['doc_id']}" for r in out.collect() for n in own)
        assert cp.STAGES[-1][1](spark, out, "").count() == out.count()


def test_run(spark, tmp_path):
    assert cp.run(spark, "/root/testdata/sf0.001").count() > 0
