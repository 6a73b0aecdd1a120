"""WARC archives of captures: writing, reading, and assembling transactions.

A capture is three records: the response (or a revisit of an equal one), the request and the metadata, the latter two with
``WARC-Concurrent-To`` the first. Archives are WARC/1.0 files of one gzip member a record. Record ids are derived from the
page, so a task that runs again writes the same bytes. ``read_records`` reads any such archive, also with several records
a member or uncompressed; ``transactions`` joins the records through their identifiers into one nested row a capture.

Of pages with equal payloads of at least ``least`` bytes, those with the largest page_id are responses and the others
revisit it. Which digests repeat is found from digests alone; the pages are joined with these by digest, where a hot one is
a skewed join side that Spark splits.

Defined cases: null html is an empty payload, a null url an empty target; rows that repeat a page_id with another
url or payload are captures of their own, rows that repeat all three are one capture, written and reported as often as they
stand; a null page_id is a response unless its payload has a page with an id; an empty table gives no
archives and no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import chunks, scratch_path, tidy, written

_DATE = "2020-01-01T00:00:00Z"
_RECORD = "record_id string, type string, concurrent_to string, refers_to string, uri string, page_id long, payload_bytes long, payload_digest string, fields map<string,string>, payload binary"


def record_id(page_id: int | None, tag: int, kind: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}/{tag}/{kind}'.encode()).digest())}>"


def record(kind: str, ident: str, uri: str, content_type: str, block: bytes, **more: str) -> bytes:
    """One record as a gzip member."""
    head = {"WARC-Type": kind, "WARC-Record-ID": ident, "WARC-Date": _DATE, "WARC-Target-URI": uri, **{k.replace("_", "-"): v for k, v in more.items()}, "Content-Type": content_type, "Content-Length": str(len(block))}
    lines = ["WARC/1.0", *(f"{k}: {re.sub(r'[\x00-\x1f\x7f]', lambda m: f'%{ord(m[0]):02X}', v)}" for k, v in head.items() if v)]
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + press.flush()


def capture(page_id: int | None, tag: int, url: str, html: bytes, original: tuple[int, int] | None) -> bytes:
    """The three records of a page; ``original`` (page_id, tag) is what it revisits."""
    ident = record_id(page_id, tag, "response")
    digest = hashlib.sha1(html).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    own = {"WARC_Payload_Digest": f"sha1:{digest}"}
    if original:
        own |= {"WARC_Refers_To": record_id(*original, "response"), "WARC_Profile": "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"}
    first = record("revisit" if original else "response", ident, url, "application/http; msgtype=response", http if original else http + html, **own)
    ask = record("request", record_id(page_id, tag, "request"), url, "application/http; msgtype=request", b"GET / HTTP/1.1\r\n\r\n", WARC_Concurrent_To=ident)
    told = f"page-id: {'' if page_id is None else page_id}\r\npayload-bytes: {len(html)}\r\n".encode()
    return first + ask + record("metadata", record_id(page_id, tag, "metadata"), url, "application/warc-fields", told, WARC_Concurrent_To=ident)


class _Bytes:
    """Reads across gzip members, or plain bytes, a record at a time."""

    def __init__(self, file: BinaryIO):
        self.file, self.have, self.press, self.rest = file, bytearray(), None, b""
        start = file.read(1 << 20)
        self.plain = start[:2] != b"\x1f\x8b"
        self.rest = start

    def more(self) -> bool:
        data = self.rest or self.file.read(1 << 20)
        self.rest = b""
        if not data:
            return False
        if self.plain:
            self.have += data
            return True
        self.press = self.press or zlib.decompressobj(31)
        self.have += self.press.decompress(data)
        if self.press.eof:
            self.rest, self.press = self.press.unused_data, None
        return True

    def until(self, mark: bytes) -> bytes | None:
        at = 0
        while (at := self.have.find(mark, max(0, at))) < 0:
            at = len(self.have) - len(mark)
            if not self.more():
                return None
        out = bytes(self.have[:at])
        del self.have[: at + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.have) < n:
            if not self.more():
                raise ValueError("the archive ends inside a record")
        out = bytes(self.have[:n])
        del self.have[:n]
        return out


def _fields(text: bytes) -> dict[str, str]:
    out = {}
    for line in text.decode(errors="replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def read_records(file: BinaryIO, with_payload: bool) -> Iterator[dict]:
    source = _Bytes(file)
    while (head := source.until(b"\r\n\r\n")) is not None:
        version, _, rest = head.lstrip(b"\r\n").partition(b"\r\n")
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no record: {version[:40]!r}")
        own = _fields(rest)
        block = source.take(int(own["content-length"]))
        source.take(4)
        kind = own.get("warc-type")
        out = {"record_id": own.get("warc-record-id"), "type": kind, "concurrent_to": own.get("warc-concurrent-to"), "refers_to": own.get("warc-refers-to"), "uri": own.get("warc-target-uri", ""), "page_id": None, "payload_bytes": None, "payload_digest": None, "fields": [], "payload": None}
        if kind in ("response", "revisit"):
            http, _, payload = block.partition(b"\r\n\r\n")
            said = own.get("warc-payload-digest", "").removeprefix("sha1:")
            if kind == "response":
                digest = hashlib.sha1(payload).hexdigest()
                if said and said != digest:
                    raise ValueError(f"{out['record_id']}: payload digest")
                out |= {"payload_bytes": len(payload), "payload_digest": digest, "payload": payload if with_payload else None}
            else:
                out |= {"payload_bytes": int(_fields(http).get("content-length", 0)), "payload_digest": said}
        elif kind == "metadata":
            told = _fields(block)
            out |= {"fields": list(told.items()), "page_id": int(told["page-id"]) if told.get("page-id") else None}
        yield out


def with_types(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, tag, url, html (binary), and the page (page_id, tag) that a row revisits, or null."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("html"))
    rows = rows.withColumn("tag", F.xxhash64("url", "html")).withColumn("digest", F.when(F.octet_length("html") >= least, F.unhex(F.sha1("html"))))
    largest = rows.where("digest is not null").groupBy("digest").agg(F.max(F.struct("page_id", "tag")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first.page_id is not null").drop("n")
    # short payloads have no digest and stay out of the join
    long = rows.where("digest is not null").join(largest, "digest", "left")
    short = rows.where("digest is null").withColumn("first", F.lit(None).cast(largest.schema["first"].dataType))
    columns = ["page_id", "tag", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first.page_id")), F.col("first")).alias("first")]
    return long.select(columns).unionByName(short.select(columns))


def write_archives(pages: DataFrame, folder: str, least: int = 1000) -> list[dict]:
    """Writes the archives of all pages into the shared folder; returns one dict (part, captures) for each."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(folder)
        file = None
        n = 0
        for batch in chunks(batches, "html"):
            if file is None:
                fs.create_dir(root, recursive=True)
                name = f"{root}/captures-{task.partitionId():06d}.warc.gz"
                temporary = f"{name}.{task.taskAttemptId()}.tmp"
                file = fs.open_output_stream(temporary, compression=None)
            for r in batch.to_pylist():
                file.write(capture(r["page_id"], r["tag"], r["url"], r["html"], r["first"] and (r["first"]["page_id"], r["first"]["tag"])))
                n += 1
        if file:
            file.close()
            fs.move(temporary, name)
            yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "captures": [n]})

    return [r.asDict() for r in with_types(pages, least).mapInArrow(tidy(write), "part long, captures long").collect()]


def read_archives(spark: SparkSession, folder: str, shards: list[dict], with_payload: bool = True) -> DataFrame:
    """All records of the archives, one task an archive; payloads are checked against their digests."""
    if not shards:
        return spark.createDataFrame([], _RECORD)
    parts = [s["part"] for s in shards]
    kinds = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("uri", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for k in batch.column("id").to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{root}/captures-{parts[k]:06d}.warc.gz", compression=None) as file:
                    for r in read_records(file, with_payload):
                        rows.append(r)
                        size += 200 + len(r["payload"] or b"")
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, kinds)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kinds)

    return spark.range(0, len(shards), 1, len(shards)).mapInArrow(tidy(read), _RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row a capture: its response or revisit, request and metadata, the capture that it refers to, and ``copies``: how
    often the archives hold its response. Each side is brought to one row an id before it is joined."""
    heads = records.where("type in ('response', 'revisit')").select(F.col("record_id").alias("id"), F.struct("type", "uri", "payload_bytes", "payload_digest", "payload", "refers_to").alias("response"))
    request = records.where("type = 'request'").select(F.col("concurrent_to").alias("id"), F.struct("record_id", "uri").alias("request"))
    metadata = records.where("type = 'metadata'").select(F.col("concurrent_to").alias("id"), F.struct("record_id", "page_id", "fields").alias("metadata"))
    heads = heads.groupBy("id").agg(F.first("response").alias("response"), F.count(F.lit(1)).alias("copies"))
    request, metadata = request.dropDuplicates(["id"]), metadata.dropDuplicates(["id"])
    whole = heads.join(request, "id", "left").join(metadata, "id", "left")
    again = whole.where(F.col("response.refers_to").isNotNull()).withColumn("to", F.col("response.refers_to"))
    ids = metadata.select(F.col("id").alias("to"), F.col("metadata.page_id").alias("original"))
    again = again.join(ids, "to", "left").drop("to")
    return whole.where(F.col("response.refers_to").isNull()).withColumn("original", F.lit(None).cast("long")).unionByName(again)


def capture_report(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Writes, reads back and assembles: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    # a table: read once, and of a known size when joins are planned
    rows = transactions(written(read_archives(spark, folder, write_archives(pages, folder, least), with_payload=False), "records"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select(F.col("metadata.page_id").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"), F.col("original").alias("refers_to"))
