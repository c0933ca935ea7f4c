"""Round trips of archives."""

import gzip
import hashlib
from pathlib import Path

import pytest

from sceneline.llm import warc

ODD = [
    "WARC/1.1\r\nWARC-Type: response\r\n\r\nx",
    "\r\nWARC/1.1\r\n",
    "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc",
    "a\r\n\r\nWARC/1.1",
    "\r\n\r\n\r\n\r\nWARC/1.1\r\n\r\n\r\nWARC/1.1\r\n",
    "ends with\r\n\r\n",
    "\r\n\r\n",
    "\r",
    "é€😀" * 50,
    "",
]


@pytest.mark.parametrize("size", [1, 2, 3, 5, 16, 100, 1 << 16])
def test_cut(size):
    for text in ODD:
        raw = text.encode()
        pieces = list(warc.cut(raw, max(size, 4)))
        assert b"".join(pieces) == raw
        for p in pieces:
            assert p.decode() is not None
            assert (b"0\r\n\r\n" + p + b"\r\n\r\n").find(b"\r\n\r\nWARC/1.1") == -1


@pytest.mark.parametrize("size", [7, 64, 1 << 16])
def test_round_trip(spark, size):
    long = "<p>långt</p>\r\n" * 400
    rows = [(i, f"http://e.org/{i} x", t) for i, t in enumerate(ODD)]
    rows += [(100, None, long), (101, "u", long), (102, "u", long), (103, "u", None), (7, "u", "short"), (8, "u", "short"), (102, "again", long), (None, "n", long + "!")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, chunk string")
    got = sorted((tuple(r) for r in warc.round_trip(pages, size).collect()), key=str)
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        again = html == long and i < 102
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", 102 if again else None))
    assert got == sorted(want, key=str)


def test_archives_are_valid(spark, tmp_path):
    """Read by the standard's rules alone: version line, header, as many bytes as said, end mark."""
    pages = spark.createDataFrame([(i, "http://e.org/", t) for i, t in enumerate(ODD)], "page_id long, url string, html string")
    warc.write(pages, f"file://{tmp_path}/w", 16)
    found = {}
    for f in Path(tmp_path, "w").glob("part-*"):
        data = gzip.decompress(f.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            fields = dict(x.split(": ", 1) for x in lines[1:])
            n = int(fields["Content-Length"])
            assert rest[n : n + 4] == b"\r\n\r\n"
            name = fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"])
            found.setdefault(name, []).append((int(fields.get("WARC-Segment-Number", 1)), rest[:n]))
            data = rest[n + 4 :]
    assert sorted(b"".join(b for _, b in sorted(v)).decode() for v in found.values()) == sorted(ODD)


def test_many_repeated_digests(spark):
    """Beyond a broadcast, a digest of a third of the pages is looked up apart, and html is not shuffled by digest."""
    texts = [f"{k:04d}" + "y" * 1200 for k in range(40)]
    rows = [(i, "u", texts[0] if i % 3 == 0 else texts[i % 37 + 1] if i % 3 == 1 else None if i % 5 == 0 else f"short {i % 4}" if i % 5 == 1 else f"{i}" * 600) for i in range(600)]
    rows += [(9, "again", texts[0]), (None, "n", texts[0]), (None, "n", texts[5]), (599, "u", texts[0]), (1, "u", texts[3])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    columns = ["page_id", "html", "digest", "bytes", "revisit", "refers_to"]
    kept = {}
    for i, _, html in rows:
        if html and len(html) >= warc.MIN_DEDUP and i is not None:
            kept[html] = max(kept.get(html, -1), i)
    want = []
    for i, _, html in rows:
        revisit = i is not None and i < kept.get(html, -1)
        want.append((i, html, hashlib.sha1((html or "").encode()).hexdigest(), len(html or ""), revisit, kept[html] if revisit else None))
    for most in (10**6, 0):
        found = warc.planned(pages, most, 100)
        assert sorted(map(tuple, found.select(*columns).collect()), key=str) == sorted(want, key=str)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "LeftOuter" in line]
    assert len(joins) == 1 and "page_id" in joins[0] and "digest" in joins[0]


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
