"""Web archive files: oversized payloads go out and come back as segments, each with the digest of the payload so far.

A row of the chunk table is one record of the archive file: the first segment
of a page is a ``response`` record, further ones are ``continuation`` records
that name it and carry a segment number. The end of a record in this format is
an empty line, which is also the row separator of the text files that Spark
writes and reads; the reader puts separators back into the stream and cuts it
by Content-Length, so empty lines inside a payload do no harm.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import columns, text_arrays, text_bytes
from tracewright.operators.joining import lookup_join
from tracewright.session import settle

CHUNK_BYTES = 1 << 16
# Shorter payloads are stored again rather than referred to.
LEAST_REVISIT = 1000
END = b"\r\n\r\n"
BATCH_BYTES = 4 << 20


def _record_id(page_id, segment: int = 1) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{segment}')}>"


def _head(fields: list) -> bytes:
    return ("WARC/1.1\r\n" + "\r\n".join(f"{k}: {v}" for k, v in fields if v is not None)).encode() + END


def segments(page_id, url, payload, digest: str, length: int, refers_to, chunk: int) -> Iterator[bytes]:
    """The records of one page, without the closing empty line; ``payload`` is any buffer of UTF-8 bytes."""
    if url is not None:
        url = "".join(c if c.isprintable() else "%%%02X" % ord(c) for c in url)
    own = [("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-Id", page_id), ("X-Payload-Length", length)]
    if refers_to is not None:
        yield _head([("WARC-Type", "revisit"), ("WARC-Record-ID", _record_id(page_id)), *own,
                     ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                     ("WARC-Refers-To", _record_id(refers_to)), ("X-Refers-To-Page-Id", refers_to), ("Content-Length", 0)])
        return
    so_far, start, number = hashlib.sha1(), 0, 1
    while True:
        end = min(start + chunk, length)
        while end < length and end > start + 1 and payload[end] & 0xC0 == 0x80:
            end -= 1
        block = bytes(payload[start:end])
        so_far.update(block)
        last = end == length
        kind = [("WARC-Type", "response"), ("WARC-Record-ID", _record_id(page_id)), *own] if number == 1 else [
            ("WARC-Type", "continuation"), ("WARC-Record-ID", _record_id(page_id, number)), ("WARC-Segment-Origin-ID", _record_id(page_id))]
        yield _head([*kind, ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"), ("X-Running-Digest", f"sha1:{so_far.hexdigest()}"),
                     ("WARC-Segment-Number", None if last and number == 1 else number),
                     ("WARC-Segment-Total-Length", length if last and number > 1 else None),
                     ("Content-Type", "text/html"), ("Content-Length", end - start)]) + block
        if last:
            return
        start, number = end, number + 1


def mark_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, html with payload_bytes, payload_digest and refers_to (the largest page_id with an equal payload, for the others).

    Only digests that occur more than once are looked up; the payloads aren't shuffled.
    """
    rows = columns(pages, "page_id", "url", "html").withColumns({
        "payload_bytes": text_bytes(F.col("html")),
        "payload_digest": F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))})
    long = rows.where(F.col("payload_bytes") >= least)
    copies = long.groupBy("payload_digest").agg(F.count("*").alias("n"), F.max("page_id").alias("__first")).where("n > 1")
    rows = lookup_join(rows, settle(copies.select("payload_digest", "__first"), "warc-copies"), ["payload_digest"], "left", row_bytes=96)
    other = F.col("__first").isNotNull() & (F.col("payload_bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("__first"))
    return rows.withColumn("refers_to", F.when(other, F.col("__first"))).drop("__first")


def write_archive(pages: DataFrame, path: str, chunk: int = CHUNK_BYTES, least: int = LEAST_REVISIT) -> None:
    """Write ``pages`` (page_id, url, html, ...) as a folder of gzipped archive files, one per task.

    Payload is the html in UTF-8 (null: empty). Of equal payloads of at least
    ``least`` bytes the one with the largest page_id is stored, the others refer
    to it; rows that share that page_id are all stored, a null page_id never
    refers to itself and is written without an id. A null url is left out. An
    empty table gives a folder without records. Other columns are ignored.
    A retried task writes its file anew through Spark's commit protocol.
    """
    marked = mark_revisits(pages, least)

    def records(batches):
        import pyarrow as pa

        for batch in batches:
            data, at = text_arrays(batch.column("html"))
            data, out, held = memoryview(data), [], 0
            for i, row in enumerate(zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "payload_digest", "payload_bytes", "refers_to")])):
                page_id, url, digest, length, refers_to = row
                for record in segments(page_id, url, data[at[i]:at[i + 1]], digest, length, refers_to, chunk):
                    out.append(record)
                    held += len(record)
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])

    (marked.mapInArrow(records, "value string").write.option("lineSep", END.decode()).option("compression", "gzip").text(path))


class Reader:
    """Cuts the byte stream of one archive file into records and follows the payload digest from segment to segment."""

    def __init__(self):
        self.held, self.so_far, self.page = bytearray(), None, None

    def feed(self, piece: bytes) -> Iterator[tuple]:
        self.held += piece
        self.held += END
        while (head_end := self.held.find(END)) >= 0:
            lines = bytes(self.held[:head_end]).decode().split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError("not an archive record")
            head = dict(line.split(": ", 1) for line in lines[1:])
            start = head_end + len(END)
            end = start + int(head["Content-Length"])
            if len(self.held) < end + len(END):
                return
            if self.held[end:end + len(END)] != END:
                raise ValueError("record length does not fit")
            yield from self._record(head, memoryview(self.held)[start:end].tobytes())
            del self.held[:end + len(END)]

    def _record(self, head: dict, block: bytes) -> Iterator[tuple]:
        kind = head["WARC-Type"]
        if kind != "continuation":
            page_id, refers_to = head.get("X-Page-Id"), head.get("X-Refers-To-Page-Id")
            self.page = (page_id and int(page_id), head.get("WARC-Target-URI"), kind, refers_to and int(refers_to), head["WARC-Record-ID"],
                         head["WARC-Payload-Digest"], int(head["X-Payload-Length"]))
            self.so_far, self.length = hashlib.sha1(), 0
        page_id, url, first, refers_to, record_id, digest, length = self.page
        if kind == "revisit":
            yield page_id, url, length, digest[5:], kind, refers_to
            return
        if kind == "continuation" and head["WARC-Segment-Origin-ID"] != record_id:
            raise ValueError("segment of another record")
        self.so_far.update(block)
        self.length += len(block)
        if f"sha1:{self.so_far.hexdigest()}" != head["X-Running-Digest"]:
            raise ValueError(f"segment of {record_id} is damaged")
        if "WARC-Segment-Number" not in head or "WARC-Segment-Total-Length" in head:
            if self.length != length or f"sha1:{self.so_far.hexdigest()}" != digest:
                raise ValueError(f"payload of {record_id} is damaged")
            yield page_id, url, self.length, self.so_far.hexdigest(), first, refers_to

    def close(self):
        if self.held:
            raise ValueError("archive ends inside a record")


INDEX = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per page from the records of a folder of archive files.

    Files are streamed, a segment at a time; digests and lengths of stored
    payloads come from the bytes read and must equal those in the headers,
    else the job fails.
    """
    lines = (spark.read.schema("value string").option("lineSep", END.decode()).text(path)
             .select("value", F.col("_metadata.file_path").alias("file")))

    def pages(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = [x.split()[0] for x in INDEX.split(", ")]
        file, reader = None, Reader()
        for batch in batches:
            found = []
            data, at = text_arrays(batch.column("value"))
            data = memoryview(data)
            for i, name in enumerate(batch.column("file").to_pylist()):
                if name != file:
                    reader.close()
                    file, reader = name, Reader()
                found += reader.feed(data[at[i]:at[i + 1]])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)
        reader.close()

    return lines.mapInArrow(pages, INDEX)
