"""WARC archives by way of a chunked record table.

Each row of the pages gets a record number, and its payload is cut into rows <record number, chunk
number, chunk> as it is read; a digest and a size run along and are kept in each row, those of the
whole payload in a head row that sorts before the chunks. So neither the writer nor the reader holds
a whole payload: the writer streams head rows and chunks as they come sorted, the reader streams the
archive and carries a running digest. Of records with equal payloads the one of least id is a
response, others are revisit records that refer to it and whose chunks are not written.

Chunks are deflated as they are cut, each by itself, so that they are small in the table, when they are
dealt, and in the archives, where they are strung together as they are: archives are gzip members, one per
record, that can be read one by one. They go to the shared folder
through a file system interface, one or more files per task attempt; only files that a finished task
names in the manifest count, and the manifest is written before it's used.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanmill.llm.common import delete, scratch, slices, written

#: An Arrow batch has up to 10,000 rows, so this bounds what a task holds to 160 MB.
CHUNK_BYTES = 16 << 10
#: A task begins another archive once one has so many bytes.
ARCHIVE_BYTES = 1 << 30
#: Payloads of fewer bytes are always responses.
REVISIT_BYTES = 100
#: Tasks that the copies of one payload are dealt to when they are told their response.
COPY_PARTS = 16
#: The chunk number of a head row.
HEAD = -1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"


def deflated(data: bytes | pa.Buffer) -> bytes:
    """A piece of a deflate stream that needs nothing before it."""
    own = zlib.compressobj(6, zlib.DEFLATED, -zlib.MAX_WBITS)
    return own.compress(data) + own.flush(zlib.Z_FULL_FLUSH)


def inflated(piece: bytes) -> bytes:
    return zlib.decompressobj(-zlib.MAX_WBITS).decompress(piece)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order of record and number: each deflated, with size and digest so far; a head row at a record's end."""
    running, size = hashlib.sha256(), 0
    for batch in batches:
        for part in slices(batch):
            pieces, sizes, digests, heads = [], [], [], []
            numbers, lasts = part.column("chunk_no").to_pylist(), part.column("last").to_pylist()
            for k, (data, number, last) in enumerate(zip(part.column("data"), numbers, lasts, strict=True)):
                if number == 0:
                    running, size = hashlib.sha256(), 0
                own = data.as_buffer()
                running.update(own)
                size += own.size
                pieces.append(deflated(own))
                sizes.append(size)
                digests.append(running.hexdigest())
                if number == last:
                    heads.append(k)
            rec, record_id, url = (part.column(c) for c in ("rec", "record_id", "url"))
            none = pa.nulls(len(part))
            yield pa.RecordBatch.from_arrays([rec, none.cast(pa.int64()), none.cast(pa.string()), part.column("chunk_no"), pa.array(pieces, pa.binary()), pa.array(sizes, pa.int64()), pa.array(digests)], names=CHUNK_NAMES)
            if heads:
                own, at = pa.array(heads, pa.int32()), len(heads)
                yield pa.RecordBatch.from_arrays([rec.take(own), record_id.take(own), url.take(own), pa.array([HEAD] * at, pa.int32()), pa.nulls(at, pa.binary()), pa.array([sizes[k] for k in heads], pa.int64()), pa.array([digests[k] for k in heads])], names=CHUNK_NAMES)


CHUNK_SCHEMA = "rec long, record_id long, url string, chunk_no int, data binary, bytes long, digest string"
CHUNK_NAMES = [c.split(" ")[0] for c in CHUNK_SCHEMA.split(", ")]


def chunked(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table, to be written once: its record numbers are given as rows are read.

    rec, chunk_no, data (deflated), bytes and digest (of the payload up to this chunk); a head row (chunk_no
    HEAD, no data) per record with record_id, url and the whole payload's bytes and digest. A null
    payload is empty: one chunk of no bytes; a null url is empty, ids may be null or repeated.
    """
    binary = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.monotonically_increasing_id().alias("rec"), F.col(key).cast("long").alias("record_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), binary.alias("b"))
    last = F.greatest(F.ceil(F.length("b") / chunk_bytes).cast("int") - 1, F.lit(0))
    cut = rows.select("*", last.alias("last")).select("*", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("chunk_no"))
    data = F.substring(F.col("b"), F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes))
    return cut.select("rec", "record_id", "url", "chunk_no", "last", data.alias("data")).mapInArrow(_digested, CHUNK_SCHEMA)


def revisits(table: DataFrame) -> DataFrame:
    """rec, refers_to of the records that revisit another, from the head rows of a written table alone.

    Rows without id are responses that nothing refers to; of records equal in id and payload none
    revisits another. The copies of a payload are dealt to COPY_PARTS tasks; only payloads with
    copies are told their response.
    """
    large = table.filter(F.col("chunk_no") == HEAD).filter((F.col("bytes") >= REVISIT_BYTES) & F.col("record_id").isNotNull()).select("rec", "record_id", "digest")
    first = large.groupBy("digest").agg(F.min("record_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    parts = first.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(COPY_PARTS - 1))))
    dealt = large.withColumn("part", F.pmod(F.xxhash64("rec"), F.lit(COPY_PARTS)).cast("int"))
    return dealt.join(parts, ["digest", "part"]).filter("refers_to < record_id").select("rec", "refers_to")


def placed(table: DataFrame, told: DataFrame) -> DataFrame:
    """The rows to be written with refers_to: of revisits the head row only. A record's rows are in one task, in order.

    The payloads are dealt once, by record number; the window keeps a record together however `told`
    was joined, and numbers its rows, so that the writer sees that none is missing.
    """
    typed = table.join(told, "rec", "left").filter((F.col("chunk_no") == HEAD) | F.col("refers_to").isNull())
    return typed.withColumn("seq", F.row_number().over(Window.partitionBy("rec").orderBy("chunk_no"))).sortWithinPartitions("rec", "chunk_no")


def _header(kind: str, row: dict, length: int) -> bytes:
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:record:{row['record_id']}>",
        f"WARC-Target-URI: {_one_line(row['url'])}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{row['digest']}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {length}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:record:{row['refers_to']}>"]
    return "\r\n".join(lines).encode() + CRLF + CRLF


def _http(row: dict) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['bytes']}\r\n\r\n".encode()


def _one_line(text: str) -> str:
    """A header's value stands on one line."""
    return json.dumps(text)[1:-1] if any(c in text for c in "\r\n") else text


#: The ends of a gzip member: no name, no time, any system; a last block of nothing.
MEMBER, LAST_BLOCK = b"\x1f\x8b\x08" + bytes(6) + b"\xff", b"\x03\x00"


class _Archive:
    """An archive being written: records of a head and chunks, each a gzip member of the pieces given."""

    def __init__(self, fs: pyarrow.fs.FileSystem, path: str):
        self.path, self.records, self.bytes, self._out = path, 0, 0, fs.open_output_stream(path, compression=None)
        self._open = False

    def begin(self, row: dict) -> None:
        self.end()
        kind, http = "response" if row["refers_to"] is None else "revisit", _http(row)
        self._open, self._running, self._digest = True, hashlib.sha256(), row["digest"] if kind == "response" else None
        self._check, self._size = 0, 0
        self.bytes += self._out.write(MEMBER)
        self._put(own := _header(kind, row, len(http) + (row["bytes"] if kind == "response" else 0)) + http, deflated(own))
        self.records += 1

    def chunk(self, piece: bytes) -> None:
        self._running.update(data := inflated(piece))
        self._put(data, piece)

    def end(self) -> None:
        """Close the record: what was written must have the digest of its header."""
        if not self._open:
            return
        if self._digest not in (None, self._running.hexdigest()):
            raise ValueError(f"{self.path}: the chunks of a record have another digest than its header")
        self._put(CRLF + CRLF, deflated(CRLF + CRLF))
        self.bytes += self._out.write(LAST_BLOCK + struct.pack("<II", self._check, self._size & 0xFFFFFFFF))
        self._open = False

    def close(self) -> pa.RecordBatch:
        self.end()
        self._out.close()
        return pa.RecordBatch.from_pydict({"path": [self.path], "records": [self.records], "bytes": [self.bytes]})

    def _put(self, data: bytes, piece: bytes) -> None:
        self._check, self._size = zlib.crc32(data, self._check), self._size + len(data)
        self.bytes += self._out.write(piece)


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Stream placed() rows to archives, one or more per task; the manifest: path, records, bytes.

    Written once: the manifest is a table in the shared folder.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        out = None
        for batch in batches:
            for part in slices(batch):
                for row in part.to_pylist():
                    if row["seq"] != row["chunk_no"] + 2:
                        raise ValueError(f"record {row['rec']} lacks rows before chunk {row['chunk_no']}")
                    if row["chunk_no"] != HEAD:
                        out.chunk(row["data"])
                        continue
                    if out is not None and out.bytes >= archive_bytes:
                        yield out.close()
                        out = None
                    if out is None:
                        fs.create_dir(base, recursive=True)
                        out = _Archive(fs, f"{base}/{uuid.uuid4().hex}.warc.gz")
                    out.begin(row)
        if out is not None:
            yield out.close()

    return written(rows.mapInArrow(run, "path string, records long, bytes long"), "manifest")


def parse(stream, block: int = CHUNK_BYTES) -> Iterator[dict]:
    """The records of an archive, payloads read in blocks and digested as they pass."""
    rest = b""

    def line() -> bytes:
        nonlocal rest
        while b"\r\n" not in rest:
            more = stream.read(block)
            if not more:
                raise EOFError("the archive ends within a header")
            rest += more
        own, _, rest = rest.partition(b"\r\n")
        return own

    def fields() -> dict[str, str]:
        out = {}
        while own := line():
            name, _, value = own.decode().partition(": ")
            out[name] = value
        return out

    while True:
        if not rest:
            rest = stream.read(block)
            if not rest:
                return
        if (version := line()) != b"WARC/1.1":
            raise ValueError(f"not a record: {version[:40]!r}")
        head = fields()
        left = int(head["Content-Length"])
        status = line()
        http = fields()
        left -= len(status) + 2 + sum(len(f"{k}: {v}".encode()) + 2 for k, v in http.items()) + 2
        digest, size = hashlib.sha256(), 0
        while left > 0:
            part, rest = rest[:left], rest[left:]
            if not part:
                rest = stream.read(block)
                if not rest:
                    raise EOFError("the archive ends within a payload")
                continue
            digest.update(part)
            size += len(part)
            left -= len(part)
        if line() or line():
            raise ValueError("a record isn't closed")
        yield {"head": head, "http": http, "bytes": size, "digest": digest.hexdigest()}


OUT = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType())])


def _number(urn: str) -> int | None:
    own = urn.removeprefix("<urn:record:").removesuffix(">")
    return None if own == "None" else int(own)


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record in the manifest's archives.

    Of responses, size and digest are those of the payload read, and a digest other than the header's
    is an error; of revisits, they are what the headers say of the full payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                with fs.open_input_stream(path, compression=None) as held, gzip.GzipFile(fileobj=held) as stream:
                    for r in parse(stream):
                        head, revisit = r["head"], r["head"]["WARC-Type"] == "revisit"
                        digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                        if not revisit and digest != r["digest"]:
                            raise ValueError(f"{path}: {head['WARC-Record-ID']} has another digest than its header")
                        rows.append((_number(head["WARC-Record-ID"]), int(r["http"]["Content-Length"]) if revisit else r["bytes"], digest, head["WARC-Type"], _number(head["WARC-Refers-To"]) if revisit else None))
                        if len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    # a task per archive: with a number given, the small list of paths isn't coalesced
    return manifest.select("path").repartitionByRange(max(1, manifest.count()), "path").mapInArrow(run, OUT)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive all pages, read the archives back, and return what they hold, a row per page.

    Null payloads are empty, null URLs too; other columns are left out; an empty table makes no
    archive. Rows without page id are responses; those of one page id are a record each, with the
    same record id, and of equal ones none is a revisit of another. The chunked table goes when the
    archives stand.
    """
    spark, held = pages.sparkSession, []
    folder = scratch(spark, "archives")
    table = written(chunked(pages), "chunks", held)
    told = written(revisits(table), "revisits", held)
    manifest = write_archives(placed(table, told), folder)
    delete(spark, held)
    return read_archives(manifest, folder)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, d.digest AS payload_digest,
  CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to
FROM d LEFT JOIN f ON d.digest = f.digest AND n >= 100
"""
