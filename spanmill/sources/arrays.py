"""Chunked array stores in the Zarr layout (version 2): a reader as a data source, and a writer.

An array is a folder with its metadata as JSON and a file per chunk; a group is a folder of arrays and groups. Many tasks
write chunks of one array, each file whole or not at all; the metadata come last, so an array that can be read has all its
chunks. Chunks of nothing but the fill value are not written, and chunks that aren't there are read as it.
"""

from __future__ import annotations

import gzip
import json
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from spanmill.plans.session import address, cut, drop
from spanmill.sources.tiff import OPENING, Several, bundled

#: Bytes of chunks, unpacked, in a partition.
PARTITION_BYTES = 32 << 20
#: Arrays of a group whose metadata are read at one time.
READERS = 16
SCHEMA = "array string, cy long, cx long, y0 long, x0 long, height int, width int, values array<double>"


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        fs, base = pyarrow.fs.FileSystem.from_uri(path)
    else:
        fs, base = pyarrow.fs.LocalFileSystem(), path
    return fs, base.rstrip("/")


def _read(fs: pyarrow.fs.FileSystem, path: str) -> bytes | None:
    """A file's bytes; None where there is none."""
    if fs.get_file_info(path).type != pyarrow.fs.FileType.File:
        return None
    with fs.open_input_file(path) as f:
        return f.read()


def _put(fs: pyarrow.fs.FileSystem, path: str, data: bytes) -> None:
    """Write a file under another name and give it its own when whole."""
    folder, name = path.rsplit("/", 1)
    part = f"{folder}/.part-{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(data)
    fs.move(part, path)


@dataclass(frozen=True)
class Layout:
    """What an array's metadata say; one of one dimension is a single row."""

    shape: tuple[int, int]
    chunks: tuple[int, int]
    kind: str
    packed: str | None
    fill: float
    flat: bool
    between: str
    columns_first: bool

    @classmethod
    def parsed(cls, text: bytes) -> Layout:
        m = json.loads(text)
        packed = m["compressor"]["id"] if m.get("compressor") else None
        for bad, what in ((m.get("zarr_format") != 2, "format"), (len(m["shape"]) not in (1, 2), "dimensions"), (packed not in (None, "zlib", "gzip", "zstd"), f"compressor {packed}"), (m.get("filters"), "filters"), (np.dtype(m["dtype"]).kind not in "buif", f"type {m['dtype']}")):
            if bad:
                raise ValueError(f"an array of this {what} can't be read")
        flat = len(m["shape"]) == 1
        fill = m.get("fill_value") or 0
        pad = (1,) if flat else ()
        return cls((*pad, *m["shape"]), (*pad, *m["chunks"]), m["dtype"], packed, float(fill), flat, m.get("dimension_separator", "."), m.get("order", "C") == "F")

    def name(self, cy: int, cx: int) -> str:
        return str(cx) if self.flat else f"{cy}{self.between}{cx}"

    def unpacked(self, data: bytes | None) -> np.ndarray:
        """A chunk's values as they stand in its file, to the full size of a chunk."""
        if data is None:
            return np.full(self.chunks, self.fill)
        if self.packed == "zstd":
            import zstandard

            data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
        elif self.packed:
            data = zlib.decompress(data) if self.packed == "zlib" else gzip.decompress(data)
        return np.frombuffer(data, dtype=self.kind).reshape(self.chunks, order="F" if self.columns_first else "C").astype(float)


def arrays_at(fs: pyarrow.fs.FileSystem, base: str, name: str = "") -> Iterator[tuple[str, Layout]]:
    """(name, layout) of the arrays at a folder and in the groups below, by name; chunks are not listed."""
    here = f"{base}/{name}".rstrip("/")
    held = _read(fs, f"{here}/.zarray")
    if held is not None:
        yield name, Layout.parsed(held)
        return
    if _read(fs, f"{here}/.zgroup") is None:
        if not name:
            raise FileNotFoundError(f"neither an array nor a group: {base}")
        return
    below = sorted(i.base_name for i in fs.get_file_info(pyarrow.fs.FileSelector(here)) if i.type == pyarrow.fs.FileType.Directory)
    with ThreadPoolExecutor(READERS) as pool:  # a small file each, which is waiting for the most part
        for own in pool.map(lambda n: list(arrays_at(fs, base, f"{name}/{n}".lstrip("/"))), below):
            yield from own


@dataclass
class Chunks(InputPartition):
    """A stretch of the chunks that the window meets in one array: rows and columns of chunks, numbers from first to last."""

    array: str
    layout: Layout
    rows: tuple[int, int]
    columns: tuple[int, int]
    first: int
    last: int


class ArrayReader(DataSourceReader):
    def __init__(self, options) -> None:
        options = dict(options)
        self.path = options["path"]
        self.window = tuple(int(options.get(k, d)) for k, d in (("y0", 0), ("x0", 0), ("height", 1 << 62), ("width", 1 << 62)))
        self.only = options.get("array")
        self.most = int(options.get("partitionbytes", PARTITION_BYTES))

    def partitions(self) -> list[InputPartition]:
        fs, base = _store(self.path)
        out = []
        for name, own in arrays_at(fs, base):
            if self.only not in (None, name):
                continue
            y0, x0, h, w = self.window
            rows = (max(y0, 0) // own.chunks[0], -(-min(y0 + h, own.shape[0]) // own.chunks[0]))
            columns = (max(x0, 0) // own.chunks[1], -(-min(x0 + w, own.shape[1]) // own.chunks[1]))
            n = max(rows[1] - rows[0], 0) * max(columns[1] - columns[0], 0)
            step = max(self.most // (own.chunks[0] * own.chunks[1] * np.dtype(own.kind).itemsize), 1)
            out += [Chunks(name, own, rows, columns, k, min(k + step, n)) for k in range(0, n, step)]
        size = lambda p: (p.last - p.first) * (p.layout.chunks[0] * p.layout.chunks[1] * np.dtype(p.layout.kind).itemsize + OPENING)
        return bundled(out, size, self.most)

    def read(self, partition: Chunks | Several | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # else there are none: the window meets nothing
            for part in partition.parts if isinstance(partition, Several) else [partition]:
                yield from self._read(part)

    def _read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        fs, base = _store(self.path)
        own, (wy, wx, wh, ww) = partition.layout, self.window
        folder = f"{base}/{partition.array}".rstrip("/")
        for k in range(partition.first, partition.last):
            down, across = divmod(k, partition.columns[1] - partition.columns[0])
            cy, cx = partition.rows[0] + down, partition.columns[0] + across
            y, x = cy * own.chunks[0], cx * own.chunks[1]
            top, left = max(y, wy), max(x, wx)
            grid = own.unpacked(_read(fs, f"{folder}/{own.name(cy, cx)}"))
            part = grid[top - y : min(wy + wh, own.shape[0]) - y, left - x : min(wx + ww, own.shape[1]) - x]
            columns = [pa.array([partition.array]), *[pa.array([v], pa.int64()) for v in (cy, cx, top, left)], *[pa.array([n], pa.int32()) for n in part.shape]]
            values = pa.ListArray.from_arrays(pa.array([0, part.size], pa.int32()), pa.array(np.ascontiguousarray(part).ravel()))
            yield pa.RecordBatch.from_arrays([*columns, values], names=["array", "cy", "cx", "y0", "x0", "height", "width", "values"])


class ArraySource(DataSource):
    """spark.read.format("arrays").load(path): a row per chunk; options array, y0, x0, height, width, partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "arrays"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArrayReader:
        return ArrayReader(self.options)


def read_arrays(spark: SparkSession, path: str, array: str | None = None, y0: int = 0, x0: int = 0, height: int | None = None, width: int | None = None, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Chunks of the arrays at a path (an array or a group) that a window meets, cut to it.

    array (its name below the path), cy, cx, y0, x0, height, width, values (row by row, as doubles). Booleans, integers and
    floats of one or two dimensions, plain or packed by zlib, gzip or zstd; other arrays are an error.
    Chunks that aren't there have the fill value. Only metadata are read where the read is planned, and only the chunks
    met in tasks.
    """
    spark.dataSource.register(ArraySource)
    options = {k: v for k, v in (("array", array), ("y0", y0), ("x0", x0), ("height", height), ("width", width), ("partitionBytes", partition_bytes)) if v is not None}
    return spark.read.format("arrays").options(**options).load(address(spark, path))


def array_cells(chunks: DataFrame) -> DataFrame:
    """array, y, x, v of read_arrays()'s chunks."""
    cells = chunks.select("array", "y0", "x0", "width", F.posexplode("values").alias("k", "v"))
    return cells.select("array", (F.col("y0") + F.floor(F.col("k") / F.col("width"))).alias("y"), (F.col("x0") + F.col("k") % F.col("width")).alias("x"), "v")


def write_arrays(cells: DataFrame, path: str, chunk: int | tuple[int, int] = 512, kind: str = "|u1", fill: float = 0, packed: bool = True, shapes: DataFrame | None = None) -> DataFrame:
    """Arrays of two dimensions below path from cells (array, y, x, v); returns array, height, width, chunks (written).

    An array's name may lead through groups, parted by slashes. It reaches to its greatest y and x, or as shapes (array, height,
    width) has it, then arrays without cells are written too, and a cell outside is an error. Cells that aren't
    there or null have the fill value; of several at a place the greatest value counts. A chunk's cells
    meet in one task, an array's don't. No metadata are written before all chunks are.
    """
    spark, held = cells.sparkSession, []
    path = address(spark, path)
    ch, cw = (chunk, chunk) if isinstance(chunk, int) else chunk
    at = cells.select("array", F.floor(F.col("y") / ch).alias("cy"), F.floor(F.col("x") / cw).alias("cx"), (F.col("y") % ch).cast("int").alias("dy"), (F.col("x") % cw).cast("int").alias("dx"), F.coalesce(F.col("v").cast("double"), F.lit(float(fill))).alias("v"))
    # few bytes, many files: a number of tasks that isn't coalesced
    at = at.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "array", "cy", "cx")
    grouped = at.groupBy("array", "cy", "cx").agg(F.sort_array(F.collect_list(F.struct((F.col("dy") * cw + F.col("dx")).alias("at"), "v"))).alias("px"), F.max("dy").alias("dy"), F.max("dx").alias("dx"))

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (fs, base), folder = _store(path), cache(lambda name: fs.create_dir(f"{base}/{name}", recursive=True))
        for batch in batches:
            names, cys, cxs = (batch.column(c).to_pylist() for c in ("array", "cy", "cx"))
            written = []
            for k in range(len(batch)):
                own = batch.column("px").slice(k, 1).flatten()
                grid = np.full(ch * cw, fill, dtype=kind)
                grid[own.field("at").to_numpy()] = own.field("v").to_numpy()
                written.append(int((grid != np.array(fill, dtype=kind)).any()))
                if written[-1]:
                    folder(names[k])
                    _put(fs, f"{base}/{names[k]}/{cys[k]}.{cxs[k]}", zlib.compress(grid.tobytes()) if packed else grid.tobytes())
            high = [(c * ch + d + 1, e * cw + f + 1) for c, d, e, f in zip(cys, batch.column("dy").to_pylist(), cxs, batch.column("dx").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"array": names, "written": pa.array(written, pa.int64()), "h": pa.array([h for h, _ in high], pa.int64()), "w": pa.array([w for _, w in high], pa.int64())})

    # written before anything reads it: the chunks are all there then
    chunks = cut(grouped.mapInArrow(stored, "array string, written long, h long, w long"), "chunks", held)
    known = chunks.groupBy("array").agg(F.sum("written").alias("chunks"), F.max("h").alias("h"), F.max("w").alias("w"))
    if shapes is not None:
        both = shapes.select("array", F.col("height").alias("sh"), F.col("width").alias("sw")).join(known, "array", "full")
        outside = (F.col("h") > F.col("sh")) | (F.col("w") > F.col("sw")) | F.col("sh").isNull()
        fine = F.when(outside, F.raise_error(F.concat(F.lit("cells outside of the array "), "array")).cast("long")).otherwise(F.coalesce("chunks", F.lit(0)))
        known = both.select("array", fine.alias("chunks"), F.col("sh").alias("h"), F.col("sw").alias("w"))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (fs, base), group = _store(path), cache(lambda at: _put(fs, f"{at}/.zgroup", json.dumps({"zarr_format": 2}).encode()))
        for batch in batches:
            for r in batch.to_pylist():
                parents = r["array"].split("/")[:-1]
                fs.create_dir(f"{base}/{r['array']}", recursive=True)
                for k in range(len(parents) + 1):
                    group("/".join([base, *parents[:k]]))
                meta = {"zarr_format": 2, "shape": [r["h"], r["w"]], "chunks": [ch, cw], "dtype": np.dtype(kind).str, "compressor": {"id": "zlib", "level": 6} if packed else None, "fill_value": fill, "order": "C", "filters": None}
                _put(fs, f"{base}/{r['array']}/.zarray", json.dumps(meta).encode())
            yield batch.rename_columns(["array", "height", "width", "chunks"])

    made = known.select("array", F.col("h").cast("long").alias("h"), F.col("w").cast("long").alias("w"), F.col("chunks").cast("long").alias("chunks"))
    out = cut(made.mapInArrow(described, "array string, height long, width long, chunks long"), "arrays")
    drop(spark, held)
    return out
