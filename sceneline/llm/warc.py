"""WARC archives as chunked record tables.

Writing: each payload is streamed into chunks of at most ``CHUNK`` bytes; a
row is (record, chunk number, bytes so far, digest so far), the digest being
carried on from chunk to chunk.  A chunk is one WARC record: the first of a
payload is a ``response`` record, the others are ``continuation`` records with
segment numbers, as the standard has it for oversized payloads.  A payload
equal to another one's is written as a ``revisit`` without payload.

Reading: archives are split at record starts, each record is a row again, and
the rows of a payload of several chunks, sorted by chunk number, are digested
as a stream - the payload is never put together - and checked against the
recorded digest.

Archives are written and read by Spark's own text writer and reader (gzip), so
any file system works and a lost task leaves no half-written file behind.  A
record's block never holds the separator of records: a payload that contains
it is cut into chunks within it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneline.llm.common import BROADCAST_ROWS, HOT_ROWS, materialize, scratch_path

#: Bytes of a chunk, at most.
CHUNK = 64 * 1024
#: Smaller payloads are always written whole.
MIN_DEDUP = 1000
#: Records of an archive file, at most.
FILE_RECORDS = 20_000
#: Each record begins with the version line and ends with the end mark.
VERSION, END = "WARC/1.1\r\n", "\r\n\r\n"
#: What parts two records; no block may hold its first twelve bytes, nor make them up with what stands before it.
_MARK = (END + VERSION[:8]).encode()


def cut(payload: bytes | memoryview, size: int) -> Iterator[bytes]:
    """Pieces of at most ``size`` bytes, not within a character and without what parts two records.

    No more than a piece of the payload is copied at a time.
    """
    at, n = 0, len(payload)
    while True:
        end = min(n, at + size)
        while end < n and end > at + 1 and payload[end] & 0xC0 == 0x80:
            end -= 1
        window = bytes(payload[at : min(n, end + len(_MARK))])
        # After the empty line of the header, the mark could be made up by the rest of it.
        start = next((k for k in (4, 2) if window.startswith(_MARK[k:])), None)
        if start is not None:
            end = min(end, at + 8 - start)
        elif (found := window.find(_MARK)) >= 0:
            end = min(end, at + found + 8)  # before the version's slash
        yield window[: end - at]
        at = end
        if at >= n:
            return


class Chunks:
    """For ``mapInArrow``: (page_id, url, html, refers_to, ...) to a row for each record to write."""

    def __init__(self, size: int):
        self.size = size

    def __call__(self, batches):
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            cols = {n: batch.column(n) for n in ("page_id", "url", "refers_to", "revisit", "digest", "bytes")}
            html = batch.column("html")
            rows: list[tuple] = []
            held = 0
            for i in range(batch.num_rows):
                page_id, url, refers_to, revisit, digest, size = (c[i].as_py() for c in cols.values())
                n += 1
                name = f"urn:page:{page_id}:{task}-{n}"  # repeated rows have names of their own
                head = [f"WARC-Target-URI: {' '.join(url.split())}"] if url else []
                head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
                if revisit:
                    head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
                    rows.append((page_id, 0, 0, hashlib.sha1().hexdigest(), self.record("revisit", name, 1, None, head, b"")))
                    continue
                so_far, sha = 0, hashlib.sha1()
                payload = memoryview(html[i].as_buffer() if html[i].is_valid else b"")  # the bytes of the batch, not a copy
                for number, chunk in enumerate(cut(payload, self.size), 1):
                    so_far += len(chunk)
                    sha.update(chunk)
                    last = so_far == len(payload)
                    own = [*(head if number == 1 else []), f"X-Digest-So-Far: sha1:{sha.hexdigest()}"]
                    total = so_far if last and number > 1 else None
                    rows.append((page_id, number, so_far, sha.hexdigest(), self.record("response" if number == 1 else "continuation", name, number, total, own, chunk, not last or number > 1)))
                    held += len(chunk)
                    if held > 1 << 24:
                        yield self.table(rows)
                        rows, held = [], 0
            if rows:
                yield self.table(rows)

    @staticmethod
    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string()]
        names = ["page_id", "chunk", "bytes_so_far", "digest_so_far", "value"]
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    @staticmethod
    def record(kind: str, name: str, number: int, total: int | None, head: list[str], block: bytes, segmented: bool = False) -> str:
        """Text of a record up to its end mark."""
        own = f"<{name}>" if number == 1 else f"<{name}:{number}>"
        fields = [VERSION[:-2], f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: text/html; charset=utf-8"]
        if segmented:
            fields.append(f"WARC-Segment-Number: {number}")
            if number > 1:
                fields.append(f"WARC-Segment-Origin-ID: <{name}>")
            if total is not None:
                fields.append(f"WARC-Segment-Total-Length: {total}")
        return "\r\n".join([*fields, *head, f"Content-Length: {len(block)}", "", block.decode("utf-8", "surrogatepass")])


def planned(pages: DataFrame, broadcast_rows: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``pages`` (page_id, url, html) with bytes, digest, revisit and refers_to.

    Equal payloads of at least ``MIN_DEDUP`` bytes have the same digest; the largest page_id of
    them is the response.  Up to ``broadcast_rows`` digests of several pages are broadcast.  Of
    more, only those of at least ``hot_rows`` pages are; the others are looked up by rows of
    page_id and digest alone, and html is then shuffled by page, never by digest.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", "html").withColumns({"bytes": F.octet_length(payload).cast("long"), "digest": F.sha1(payload)})
    asks = F.coalesce((F.col("bytes") >= MIN_DEDUP) & F.col("page_id").isNotNull(), F.lit(False))
    large = rows.where(F.col("bytes") >= MIN_DEDUP).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
    again = materialize(large.where("n > 1"), "warc-again")
    if again.count() <= broadcast_rows:
        found = rows.join(F.broadcast(again.select("digest", "kept")), "digest", "left")
    else:
        hot, cold = (again.where(F.col("n") >= hot_rows).select("digest", "kept"), again.where(F.col("n") < hot_rows).select("digest", "kept"))
        narrow = rows.where(asks).select("page_id", "digest")
        known = narrow.join(F.broadcast(hot), "digest").unionByName(narrow.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(cold, "digest"))
        revisits = materialize(known.where("page_id < kept").distinct(), "warc-revisits")
        found = rows.where(asks).join(revisits, ["page_id", "digest"], "left").unionByName(rows.where(~asks).withColumn("kept", F.lit(None).cast("long")))
    revisit = F.coalesce(asks & (F.col("page_id") < F.col("kept")), F.lit(False))
    return found.withColumns({"revisit": revisit, "refers_to": F.when(revisit, F.col("kept"))}).drop("kept")


def write(pages: DataFrame, path: str, chunk: int = CHUNK) -> None:
    """Write the archives of ``pages`` below ``path``."""
    records = planned(pages).mapInArrow(Chunks(chunk), "page_id long, chunk int, bytes_so_far long, digest_so_far string, value string")
    records.select("value").write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _field(name: str):
    # A field's line in the header; the first line has no line end before it.
    return F.regexp_extract("head", rf"(?:^|\r\n){name}: ([^\r]*)", 1)


def records(spark: SparkSession, path: str) -> DataFrame:
    """The chunked record table of the archives below ``path``: a row for each record."""
    lines = spark.read.option("lineSep", END + VERSION).text(path)
    split = F.split("value", "\r\n\r\n", 2)
    rows = lines.select(F.element_at(split, 1).alias("head"), F.try_element_at(split, F.lit(2)).alias("block"))
    number = F.coalesce(F.nullif(_field("WARC-Segment-Number"), F.lit("")).cast("int"), F.lit(1))
    origin = F.coalesce(F.nullif(_field("WARC-Segment-Origin-ID"), F.lit("")), _field("WARC-Record-ID"))
    return rows.select(
        origin.alias("record"),
        number.alias("chunk"),
        (_field("WARC-Segment-Number") != "").alias("segmented"),
        _field("WARC-Type").alias("type"),
        F.nullif(F.regexp_extract(_field("WARC-Refers-To"), r"urn:page:([-0-9]+)", 1), F.lit("")).cast("long").alias("refers_to"),
        F.nullif(F.regexp_extract(_field("WARC-Payload-Digest"), r"sha1:([0-9a-f]+)", 1), F.lit("")).alias("payload_digest"),
        F.nullif(_field("X-Payload-Length"), F.lit("")).cast("long").alias("payload_length"),
        _field("Content-Length").cast("long").alias("content_length"),
        F.coalesce("block", F.lit("")).alias("block"),
    )


_OUT = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
_OUT_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


class Digest:
    """For ``mapInArrow`` over records whose chunks follow each other: one row for each payload.

    Only the running digest is held from chunk to chunk.  A block that is not as long as its
    header says, a missing chunk or a digest other than the recorded one fails the task.
    """

    def __call__(self, batches):
        names = ["record", "chunk", "type", "refers_to", "payload_digest", "payload_length", "content_length", "block"]
        open_ = None  # [record, type, refers_to, digest, length, sha, bytes, chunks]
        for batch in batches:
            done = []
            cols = [batch.column(n) for n in names]
            for i in range(batch.num_rows):
                record, chunk, kind, refers_to, digest, length, content, block = (c[i].as_py() for c in cols)
                block = block.encode("utf-8", "surrogatepass")
                if len(block) == content + len(END) and block.endswith(END.encode()):  # the last record of a file
                    block = block[:content]
                if len(block) != content:
                    raise ValueError(f"record {record}, chunk {chunk}: {len(block)} bytes, not {content}")
                if chunk == 1:
                    if open_:
                        done.append(self.close(open_))
                    open_ = [record, kind, refers_to, digest, length, hashlib.sha1(), 0, 0]
                if not open_ or open_[0] != record or open_[7] != chunk - 1:
                    raise ValueError(f"record {record}: chunk {chunk} does not follow")
                open_[5].update(block)
                open_[6] += len(block)
                open_[7] = chunk
            if done:
                yield self.table(done)
        if open_:
            yield self.table([self.close(open_)])

    @staticmethod
    def close(o: list) -> tuple:
        record, kind, refers_to, digest, length, sha, size, _ = o
        if kind == "response" and (sha.hexdigest() != digest or size != length):
            raise ValueError(f"record {record}: {size} bytes with digest {sha.hexdigest()}, not {length} with {digest}")
        page_id = record.split(":")[2]
        return (None if page_id == "None" else int(page_id), length, digest, kind, refers_to)

    @staticmethod
    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=_OUT)


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each payload in the archives below ``path``."""
    rows = records(spark, path)
    single = rows.where(~F.col("segmented")).mapInArrow(Digest(), _OUT_SCHEMA)
    several = rows.where("segmented").repartition("record").sortWithinPartitions("record", "chunk").mapInArrow(Digest(), _OUT_SCHEMA)
    return single.union(several)


def round_trip(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Archives of ``pages`` written to the shared folder and read back.

    A null payload is empty.  A null page_id is read back as null; repeated rows are records
    each on their own, and equal rows of the largest page_id are all responses.  White space in
    a url is written as one space.  Other columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages, path, chunk)
    return payloads(spark, path)
