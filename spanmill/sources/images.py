"""Masks as PNG images in ZIP archives, written from runs and read back to them.

A task writes one archive, member after member and row after row: what it holds is one row of pixels. Sizes and checksums
follow each member, the directory comes last. Archives have a name of their own until the job commits.
"""

from __future__ import annotations

import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from spanmill.plans.session import address
from spanmill.sources.arrays import _store
from spanmill.sources.tiff import opened

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes of compressed pixels in a chunk, and of an image read at once.
CHUNK = 1 << 16
SCHEMA = "name string, h int, w int, y int, runs array<struct<lo: int, hi: int, v: int>>"


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(h: int, w: int, rows: Iterator[tuple[int, list[dict[str, int]]]]) -> Iterator[bytes]:
    """Pieces of a PNG of 8 bit grey: the runs (lo, hi, v) of rows in order, all else 0."""
    yield SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0))
    packer, held, done, empty = zlib.compressobj(6), b"", 0, bytes(w + 1)
    for y, runs in rows:
        while done < y:
            held += packer.compress(empty)
            done += 1
        line = bytearray(w + 1)
        for r in runs:
            line[r["lo"] + 1 : r["hi"] + 1] = bytes([r["v"]]) * (r["hi"] - r["lo"])
        held += packer.compress(bytes(line))
        done += 1
        if len(held) >= CHUNK:
            yield chunk(b"IDAT", held)
            held = b""
    while done < h:
        held += packer.compress(empty)
        done += 1
    yield chunk(b"IDAT", held + packer.flush()) + chunk(b"IEND", b"")


class Archive:
    """A ZIP file written from beginning to end; members are as they come, which images are packed already for."""

    def __init__(self, out) -> None:
        self.out, self.at, self.members = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, pieces: Iterator[bytes]) -> None:
        begin, crc, size, raw = self.at, 0, 0, name.encode()
        # bit 3: sizes follow the member; bit 11: names are UTF-8
        self._put(struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0x808, 0, 0, 0x21, 0, 0, 0, len(raw), 0) + raw)
        for p in pieces:
            crc, size = zlib.crc32(p, crc), size + len(p)
            self._put(p)
        if size >= 1 << 32:
            raise ValueError(f"{name}: an image of over 4 GB packed")
        self._put(struct.pack("<4sIII", b"PK\7\x08", crc, size, size))
        self.members.append((raw, crc, size, begin))

    def close(self) -> None:
        begin = self.at
        for raw, crc, size, at in self.members:
            wide = struct.pack("<HHQ", 1, 8, at)  # where the member begins may need 8 bytes
            self._put(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0x808, 0, 0, 0x21, crc, size, size, len(raw), len(wide), 0, 0, 0, 0, 0xFFFFFFFF) + raw + wide)
        size, n, end = self.at - begin, len(self.members), self.at
        self._put(struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, n, n, size, begin))
        self._put(struct.pack("<4sIQI", b"PK\6\7", 0, end, 1))
        self._put(struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
        self.out.close()


@dataclass
class Written(WriterCommitMessage):
    part: str | None
    final: str | None


class MaskWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, base = _store(self.path)
        own, archive, part = uuid.uuid4().hex, None, None

        def rows() -> Iterator[tuple[str, int, int, int | None, list]]:
            for batch in batches:
                yield from zip(*[batch.column(c).to_pylist() for c in ("name", "h", "w", "y", "runs")], strict=True)

        stream = rows()
        row = next(stream, None)
        while row is not None:
            if archive is None:
                fs.create_dir(base, recursive=True)
                part = f"{base}/.masks-{own}.zip"
                archive = Archive(fs.open_output_stream(part))
            name, h, w = row[:3]

            def lines(name: str = name) -> Iterator[tuple[int, list]]:
                nonlocal row
                while row is not None and row[0] == name:
                    if row[3] is not None:
                        yield row[3], row[4]
                    row = next(stream, None)

            archive.add(f"{name}.png", png(h, w, lines()))
        if archive is not None:
            archive.close()
        return Written(part, f"{base}/masks-{own}.zip" if part else None)

    def commit(self, messages: list[Written | None]) -> None:
        fs, _ = _store(self.path)
        for m in messages:
            if m is not None and m.part:
                fs.move(m.part, m.final)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = _store(self.path)
        for m in messages:
            if m is not None and m.part and fs.get_file_info(m.part).type == pyarrow.fs.FileType.File:
                fs.delete_file(m.part)


class MaskSink(DataSource):
    """df.write.format("masks").save(path): rows sorted by name and y within partitions, as write_masks() makes them."""

    @classmethod
    def name(cls) -> str:
        return "masks"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> MaskWriter:
        return MaskWriter(self.options["path"])


def write_masks(runs: DataFrame, sizes: DataFrame, path: str, archives: int | None = None) -> None:
    """A PNG NAME.png of 8 bit grey for each row of sizes (name, h, w), in archives below path, about as many as asked for.

    runs: name, y, lo, hi, v (1 to 255) along rows, ends excluded, which don't overlap; what no run covers is 0. Names are
    unique in sizes and fit for files; runs of other names are left out, those outside an image are an error, null ones too. An archive
    is one task's; a failed or repeated task leaves nothing that readers see.
    """
    spark = runs.sparkSession
    spark.dataSource.register(MaskSink)
    held = runs.groupBy("name", F.col("y").cast("int").alias("y")).agg(F.sort_array(F.collect_list(F.struct(*[F.col(c).cast("int").alias(c) for c in ("lo", "hi", "v")]))).alias("runs"))
    rows = sizes.select("name", F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w")).join(held, "name", "left").select("name", "h", "w", "y", "runs")
    inside = F.col("runs").isNull() | ((F.col("y") >= 0) & (F.col("y") < F.col("h")) & F.forall("runs", lambda r: (r["lo"] >= 0) & (r["lo"] < r["hi"]) & (r["hi"] <= F.col("w")) & r["v"].between(1, 255)))
    fine = F.when(F.coalesce(inside, F.lit(False)), F.col("runs")).otherwise(F.raise_error(F.concat(F.lit("runs outside of the image "), F.col("name"))).cast("array<struct<lo: int, hi: int, v: int>>"))
    n = archives or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.withColumn("runs", fine).repartition(n, "name").sortWithinPartitions("name", "y").write.format("masks").mode("append").save(address(spark, path))


def unfiltered(kind: int, line: np.ndarray, above: np.ndarray) -> np.ndarray:
    """A row of bytes of a PNG, each a pixel or more, given how it was filtered and the row above."""
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line, dtype=np.uint8)
    if kind == 2:
        return line + above
    out, up, left, corner = line.tolist(), above.tolist(), 0, 0
    for k, b in enumerate(up):
        if kind == 3:
            guess = (left + b) // 2
        else:  # of left, above and the corner the nearest to left + above - corner
            p = left + b - corner
            guess = min((abs(p - left), 0, left), (abs(p - b), 1, b), (abs(p - corner), 2, corner))[2]
        left, corner = (out[k] + guess) & 255, b
        out[k] = left
    return np.array(out, dtype=np.uint8)


def png_rows(f) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(h, w, y, values) of a PNG of grey, of 1 or 8 bits and not interlaced, row by row."""
    if f.read(8) != SIGNATURE:
        raise ValueError("no PNG image")
    h = w = bits = y = 0
    unpacker, held, above = zlib.decompressobj(), b"", None
    while True:
        size, kind = struct.unpack(">I4s", f.read(8))
        data = f.read(size)
        if struct.unpack(">I", f.read(4))[0] != zlib.crc32(kind + data):
            raise ValueError("a chunk of a PNG image is damaged")
        if kind == b"IHDR":
            w, h, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", data)
            if colour != 0 or bits not in (1, 8) or interlaced:
                raise ValueError("a PNG of colours, other depths or interlaced can't be read")
            line = (w * bits + 7) // 8
            above = np.zeros(line, dtype=np.uint8)
        elif kind == b"IDAT":
            while data:
                held += unpacker.decompress(data, CHUNK)
                data = unpacker.unconsumed_tail
                while len(held) > line and y < h:
                    above = unfiltered(held[0], np.frombuffer(held[1 : line + 1], dtype=np.uint8), above)
                    yield h, w, y, above if bits == 8 else np.unpackbits(above)[:w]
                    held, y = held[line + 1 :], y + 1
        elif kind == b"IEND":
            if y < h:
                raise ValueError("a PNG image is cut off")
            return


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    """name, h, w, y, lo, hi, v: the runs along rows of all PNG members of the archives (*.zip) below path; empty images have a row of nulls.

    An archive is one task's, which holds a row of pixels of it. Members that aren't images are left out.
    """
    path = address(spark, path)
    fs, base = _store(path)
    prefix = path.rstrip("/")
    found = sorted(prefix + i.path[len(base) :] for i in fs.get_file_info(pyarrow.fs.FileSelector(base, recursive=True)) if i.path.endswith(".zip") and not i.base_name.startswith("."))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("name", "h", "w", "y", "lo", "hi", "v")
        for batch in batches:
            for at in batch.column("path").to_pylist():
                with opened(at) as f, zipfile.ZipFile(f) as archive:
                    for member in (m for m in archive.namelist() if m.endswith(".png")):
                        rows, some, h, w = [], False, 0, 0
                        with archive.open(member) as image:
                            for h, w, y, line in png_rows(image):
                                edges = np.flatnonzero(np.diff(line)) + 1
                                begins, ends = np.concatenate(([0], edges)), np.concatenate((edges, [w]))
                                rows += [(member[:-4], h, w, y, int(a), int(b), int(line[a])) for a, b in zip(begins, ends, strict=True) if w and line[a]]
                                if len(rows) >= 10_000:
                                    yield _rows(rows, names)
                                    rows, some = [], True
                        if not rows and not some:
                            rows = [(member[:-4], h, w, None, None, None, None)]
                        if rows:
                            yield _rows(rows, names)

    paths = spark.createDataFrame([(p,) for p in found], "path string").repartition(max(len(found), 1))
    return paths.mapInArrow(run, "name string, h int, w int, y int, lo int, hi int, v int")


def _rows(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    kinds = [pa.string(), *[pa.int32()] * 6]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=list(names))
