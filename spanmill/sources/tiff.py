"""TIFF and BigTIFF rasters as a data source, and a writer of tiled files.

A file's directories say where each tile (or strip) stands. The reader plans from them: only the tiles that a window
meets are read, in partitions of neighbouring byte ranges, so one large file is read by many tasks and a small
window of it by one. A row is a tile of one band, cut to the image and the window.

The writer encodes tiles where their pixels are, and then puts each file together from its tiles in order: what a task
holds is one tile and the directory.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from spanmill.plans.session import address, cut, drop

# The tags read, the sizes of field types, and the codes of compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS, STRIP_COUNTS, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT, PIXEL_SCALE, TIE_POINT = 317, 322, 323, 324, 325, 339, 33550, 33922
FIELDS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q", 13: "I"}
NONE, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946
CODES = {"none": NONE, "lzw": LZW, "deflate": DEFLATE}
#: Bytes of tiles in a partition, and files whose directories are read at once.
PARTITION_BYTES, PLANNERS = 8 << 20, 16
#: Bytes that could be read in the time it takes to open a file.
OPENING = 1 << 16


@dataclass(frozen=True)
class Directory:
    """One page of a file: its size, how samples are kept, and where its tiles stand; tiles go by rows, and by bands where these are apart."""

    page: int
    height: int
    width: int
    samples: int
    bits: int
    signed: bool
    planar: int
    compression: int
    predictor: int
    tile_height: int
    tile_width: int
    offsets: tuple[int, ...]
    counts: tuple[int, ...]
    order: str
    scale: tuple[float, ...] = ()
    tie: tuple[float, ...] = ()

    @property
    def down(self) -> int:
        return -(-self.height // self.tile_height)

    @property
    def across(self) -> int:
        return -(-self.width // self.tile_width)


def read_directories(f) -> list[Directory]:
    """The directories of a TIFF or BigTIFF file, given read_at(bytes, offset) and size(); nothing else is read of it."""
    head = f.read_at(16, 0)
    order = {b"II": "<", b"MM": ">"}.get(bytes(head[:2]))
    kind = struct.unpack(order + "H", head[2:4])[0] if order else 0
    if kind == 42:
        at, count, entry, word = struct.unpack(order + "I", head[4:8])[0], "H", 12, "I"
    elif kind == 43:
        at, count, entry, word = struct.unpack(order + "Q", head[8:16])[0], "Q", 20, "Q"
    else:
        raise ValueError("no TIFF file")
    width = struct.calcsize(order + word)
    out, seen = [], set()
    while at and at not in seen:
        seen.add(at)
        size = struct.calcsize(order + count)
        n = struct.unpack(order + count, f.read_at(size, at))[0]
        body = f.read_at(n * entry + width, at + size)
        tags = {}
        for k in range(n):
            own = body[k * entry : (k + 1) * entry]
            tag, form, many = struct.unpack(order + "HH" + word, own[: 4 + width])
            if form in FIELDS:
                need = struct.calcsize(FIELDS[form]) * many
                raw = own[4 + width : 4 + width + need] if need <= width else f.read_at(need, struct.unpack(order + word, own[4 + width :])[0])
                tags[tag] = struct.unpack(f"{order}{many}{FIELDS[form]}", raw)
        out.append(_directory(len(out), tags, order))
        at = struct.unpack(order + word, body[n * entry :])[0]
    return out


def _directory(page: int, tags: dict[int, tuple], order: str) -> Directory:
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    width, height, samples, bits = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), tags.get(BITS, (1,))
    kind, compression, predictor = one(FORMAT, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1)
    wrong = [
        (len(set(bits)) != 1 or bits[0] not in (1, 8, 16, 32), f"samples of {bits} bits"),
        (kind not in (1, 2) or (bits[0], kind) == (32, 1), f"sample format {kind} of {bits[0]} bits"),
        (compression not in (NONE, LZW, DEFLATE, OLD_DEFLATE), f"compression {compression}"),
        (predictor not in (1, 2) or (predictor == 2 and bits[0] == 1), f"predictor {predictor}"),
        (bits[0] == 1 and samples != 1, "several samples of one bit"),
    ]
    for bad, what in wrong:
        if bad:
            raise ValueError(f"page {page}: {what} can't be read")
    tiled = TILE_OFFSETS in tags
    return Directory(
        page, height, width, samples, bits[0], kind == 2, one(PLANAR, 1), compression, predictor,
        one(TILE_HEIGHT) if tiled else min(one(ROWS, height), height), one(TILE_WIDTH) if tiled else width,
        tuple(tags[TILE_OFFSETS if tiled else STRIP_OFFSETS]), tuple(tags[TILE_COUNTS if tiled else STRIP_COUNTS]), order,
        tuple(tags.get(PIXEL_SCALE, ())), tuple(tags.get(TIE_POINT, ())),
    )


def lzw_decoded(data: bytes) -> bytes:
    """LZW as TIFF has it: codes of 9 to 12 bits, the high bits first, lengthened one code early."""
    out, table, width, held, bits, last = [], [], 9, 0, 0, b""
    base = [bytes([k]) for k in range(256)] + [b"", b""]
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 256:
            table, width, last = base[:], 9, b""
            continue
        if code == 257:
            break
        if not last:
            last = table[code]
        else:
            found = table[code] if code < len(table) else last + last[:1]
            table.append(last + found[:1])
            last = found
        out.append(last)
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)


def lzw_encoded(data: bytes) -> bytes:
    """What lzw_decoded() reads."""
    out, held, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    first = {bytes([k]): k for k in range(256)}
    table, nxt, width, run = dict(first), 258, 9, b""
    put(256, 9)
    for k in range(len(data)):
        longer = run + data[k : k + 1]
        if longer in table:
            run = longer
            continue
        put(table[run], width)
        table[longer] = nxt
        nxt += 1
        if nxt >= 4095:
            put(256, width)
            table, nxt, width = dict(first), 258, 9
        elif nxt >= 1 << width:
            width += 1
        run = longer[-1:]
    if run:
        put(table[run], width)
        if nxt + 1 >= 1 << width and width < 12:
            width += 1
    put(257, width)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def decoded_tile(data: bytes, d: Directory, rows: int | None = None) -> np.ndarray:
    """A tile's samples [row, column, sample]; a tile without bytes is all 0. rows: of a last strip, which may be shorter."""
    samples = d.samples if d.planar == 1 else 1
    rows = rows or d.tile_height
    if not data:
        return np.zeros((rows, d.tile_width, samples), dtype=np.int64)
    raw = zlib.decompress(data) if d.compression in (DEFLATE, OLD_DEFLATE) else lzw_decoded(data) if d.compression == LZW else data
    if d.bits == 1:
        line = -(-d.tile_width // 8)
        return np.unpackbits(np.frombuffer(raw[: rows * line], dtype=np.uint8).reshape(rows, line), axis=1)[:, : d.tile_width, None].astype(np.int64)
    kind = np.dtype(f"{d.order}{'i' if d.signed else 'u'}{d.bits // 8}")
    grid = np.frombuffer(raw[: rows * d.tile_width * samples * kind.itemsize], dtype=kind).reshape(rows, d.tile_width, samples)
    if d.predictor == 2:  # differences along rows, in the samples' own width
        grid = np.cumsum(grid, axis=1, dtype=grid.dtype.newbyteorder("="))
    return grid.astype(np.int64)


@dataclass
class Tiles(InputPartition):
    """Tiles of one page of a file: (number, offset, bytes), by offset."""

    path: str
    directory: Directory
    tiles: list[tuple[int, int, int]]


@dataclass
class Several(InputPartition):
    """Small partitions, as of many small files, that one task reads one after another."""

    parts: list[InputPartition]


def bundled(parts: list[InputPartition], size: Callable[[InputPartition], int], most: int) -> list[InputPartition]:
    """Partitions of about `most` bytes, of neighbouring ones that are smaller."""
    out: list[InputPartition] = []
    own, held = [], 0
    for p in [*parts, None]:
        if own and (p is None or held + size(p) > most):
            out.append(own[0] if len(own) == 1 else Several(own))
            own, held = [], 0
        if p is not None:
            own.append(p)
            held += size(p)
    return out


def _files(path: str) -> list[str]:
    """The TIFF files at a path, a file or a folder looked through; names as the path has them."""
    fs, base = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)
    info = fs.get_file_info(base)
    if info.type == pyarrow.fs.FileType.File:
        return [path]
    if info.type == pyarrow.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = fs.get_file_info(pyarrow.fs.FileSelector(base, recursive=True))
    prefix = path.rstrip("/")
    return sorted(prefix + i.path[len(base.rstrip("/")) :] for i in found if i.type == pyarrow.fs.FileType.File and i.path.lower().endswith((".tif", ".tiff")))


def opened(path: str):
    """A file to be read at places, by its address or local path."""
    fs, base = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)
    return fs.open_input_file(base)


SCHEMA = "path string, page int, band int, tile int, y0 long, x0 long, height int, width int, values array<int>"
PAGES = "path string, page int, height long, width long, samples int, bits int, compression int, tile_height int, tile_width int, tiles long, pixel_x double, pixel_y double, origin_x double, origin_y double"


class TiffReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.options = dict(options)
        self.window = tuple(int(self.options.get(k, d)) for k, d in (("y0", 0), ("x0", 0), ("height", 1 << 62), ("width", 1 << 62)))
        self.page = int(self.options["page"]) if "page" in self.options else None
        self.most = int(self.options.get("partitionbytes", PARTITION_BYTES))

    def partitions(self) -> list[InputPartition]:
        with ThreadPoolExecutor(PLANNERS) as pool:
            planned = [p for own in pool.map(self._planned, _files(self.options["path"])) for p in own]
        return bundled(planned, lambda p: sum(n for _, _, n in p.tiles) + OPENING, self.most)

    def _planned(self, path: str) -> list[Tiles]:
        """Partitions of one file: the tiles that the window meets, by offset, some bytes together."""
        out = []
        with opened(path) as f:
            pages = read_directories(f)
        for d in pages:
            if self.page not in (None, d.page):
                continue
            met = sorted((d.offsets[k], k) for k in self._met(d))
            own, held = [], 0
            for offset, k in met:
                if own and held + d.counts[k] > self.most:
                    out.append(Tiles(path, _thin(d), own))
                    own, held = [], 0
                own.append((k, offset, d.counts[k]))
                held += d.counts[k]
            if own:
                out.append(Tiles(path, _thin(d), own))
        return out

    def _met(self, d: Directory) -> Iterator[int]:
        y0, x0, h, w = self.window
        ys = range(max(y0, 0) // d.tile_height, -(-min(y0 + h, d.height) // d.tile_height))
        xs = range(max(x0, 0) // d.tile_width, -(-min(x0 + w, d.width) // d.tile_width))
        for plane in range(d.samples if d.planar == 2 else 1):
            for y in ys:
                for x in xs:
                    yield (plane * d.down + y) * d.across + x

    def read(self, partition: Tiles | Several | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # else there are none: the window meets nothing
            for part in partition.parts if isinstance(partition, Several) else [partition]:
                yield from self._read(part)

    def _read(self, partition: Tiles) -> Iterator[pa.RecordBatch]:
        d, (wy, wx, wh, ww) = partition.directory, self.window
        with opened(partition.path) as f:
            for number, offset, count in partition.tiles:
                plane, at = divmod(number, d.down * d.across)
                ty, tx = divmod(at, d.across)
                y, x = ty * d.tile_height, tx * d.tile_width
                rows = min(d.tile_height, d.height - y) if d.tile_width == d.width else d.tile_height
                grid = decoded_tile(f.read_at(count, offset) if count else b"", d, rows)
                top, left = max(y, wy), max(x, wx)
                part = grid[top - y : min(wy + wh, d.height) - y, left - x : min(wx + ww, d.width) - x]
                h, w, n = part.shape
                bands = range(n) if d.planar == 1 else [plane]
                flat = np.ascontiguousarray(part.transpose(2, 0, 1)).reshape(n, h * w).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * h * w, pa.int32()), pa.array(flat.ravel()))
                same = lambda v, kind, n=n: pa.array([v] * n, kind)
                yield pa.RecordBatch.from_arrays(
                    [same(partition.path, pa.string()), same(d.page, pa.int32()), pa.array(list(bands), pa.int32()), same(at, pa.int32()), same(top, pa.int64()), same(left, pa.int64()), same(h, pa.int32()), same(w, pa.int32()), lists],
                    names=["path", "page", "band", "tile", "y0", "x0", "height", "width", "values"],
                )


def _thin(d: Directory) -> Directory:
    """A directory without its offsets, which partitions hold of their own tiles."""
    return Directory(**{**d.__dict__, "offsets": (), "counts": ()})


class TiffSource(DataSource):
    """spark.read.format("tiff").load(path): a row per tile and band; options y0, x0, height, width, page, partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "tiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TiffReader:
        return TiffReader(self.options)


def read_tiff(spark: SparkSession, path: str, y0: int = 0, x0: int = 0, height: int | None = None, width: int | None = None, page: int | None = None, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Tiles of the TIFF files at a path (a file or a folder) that a window meets, cut to it.

    path, page, band, tile, y0, x0, height, width, values (row by row). Images, 1 to 16 bits or 32 signed, raw, LZW or
    deflated, with or without differences, tiled or in strips, samples together or apart. A window outside an image gives no
    rows of it; tiles without bytes are 0. The directories are read where the read is planned, pixels only in tasks.
    """
    spark.dataSource.register(TiffSource)
    options = {k: v for k, v in (("y0", y0), ("x0", x0), ("height", height), ("width", width), ("page", page), ("partitionBytes", partition_bytes)) if v is not None}
    return spark.read.format("tiff").options(**options).load(address(spark, path))


def tiff_pixels(tiles: DataFrame) -> DataFrame:
    """path, page, band, y, x, v of read_tiff()'s tiles."""
    px = tiles.select("path", "page", "band", "y0", "x0", "width", F.posexplode("values").alias("k", "v"))
    return px.select("path", "page", "band", (F.col("y0") + F.floor(F.col("k") / F.col("width"))).alias("y"), (F.col("x0") + F.col("k") % F.col("width")).alias("x"), "v")


def layers(tiles: DataFrame, pages: DataFrame, bands: int = 3) -> DataFrame:
    """tiles with the column layer: the band where the file's first page has as many as wanted, else the page.

    A file that keeps each band as a page of its own is read as if it had them together.
    """
    first = pages.filter("page = 0").select("path", F.col("samples").alias("__n"))
    return tiles.join(first, "path").withColumn("layer", F.when(F.col("__n") == bands, F.col("band")).otherwise(F.col("page"))).drop("__n")


def tiff_pages(paths: DataFrame) -> DataFrame:
    """A row per page of the files named in the column path: sizes, how it is kept, and where it lies (null where it doesn't say)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PAGES.split(", ")]
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                with opened(path) as f:
                    for d in read_directories(f):
                        scale, tie = (*d.scale[:2], None, None)[:2], (*d.tie[3:5], None, None)[:2]
                        rows.append((path, d.page, d.height, d.width, d.samples, d.bits, d.compression, d.tile_height, d.tile_width, len(d.offsets), *scale, *tie))
            yield pa.RecordBatch.from_pydict({n: [r[k] for r in rows] for k, n in enumerate(names)}, schema=_arrow(PAGES))

    return paths.select("path").mapInArrow(run, PAGES)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])


def encoded_tile(grid: np.ndarray, bits: int, compression: str, predictor: bool) -> bytes:
    """Samples [row, column, sample] as bytes, little end first."""
    if bits == 1:
        raw = np.packbits(grid[:, :, 0].astype(np.uint8), axis=1).tobytes()
    else:
        own = grid.astype(f"<u{bits // 8}")
        if predictor:
            own = np.concatenate([own[:, :1], np.diff(own, axis=1)], axis=1).astype(own.dtype)
        raw = own.tobytes()
    return zlib.compress(raw, 6) if compression == "deflate" else lzw_encoded(raw) if compression == "lzw" else raw


def header(height: int, width: int, samples: int, bits: int, compression: str, predictor: bool, tile: int, counts: list[int], scale: tuple[float, float] = (1.0, 1.0)) -> bytes:
    """A BigTIFF's head and directory, after which the tiles stand in order; counts: their bytes."""
    doubles = lambda *v: (12, len(v), struct.pack(f"<{len(v)}d", *v))
    shorts = lambda *v: (3, len(v), struct.pack(f"<{len(v)}H", *v))
    longs = lambda v: (16, len(v), struct.pack(f"<{len(v)}Q", *v))

    def built(offsets: list[int]) -> bytes:
        tags = [
            (WIDTH, longs([width])), (HEIGHT, longs([height])), (BITS, shorts(*[bits] * samples)), (COMPRESSION, shorts(CODES[compression])), (PHOTOMETRIC, shorts(2 if samples == 3 else 1)), (SAMPLES, shorts(samples)), (PLANAR, shorts(1)),
            (PREDICTOR, shorts(2 if predictor else 1)), (TILE_WIDTH, shorts(tile)), (TILE_HEIGHT, shorts(tile)), (TILE_OFFSETS, longs(offsets)), (TILE_COUNTS, longs(counts)), (FORMAT, shorts(*[1] * samples)), (PIXEL_SCALE, doubles(*scale, 0.0)), (TIE_POINT, doubles(*[0.0] * 6)),
        ]
        place, body, apart = 16 + 8 + 20 * len(tags) + 8, b"", b""
        for tag, (form, many, raw) in sorted(tags):
            if len(raw) > 8:  # kept apart, its place here
                here = struct.pack("<Q", place + len(apart))
                apart += raw + b"\0" * (-len(raw) % 8)
                raw = here
            body += struct.pack("<HHQ", tag, form, many) + raw.ljust(8, b"\0")
        return struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) + struct.pack("<Q", len(tags)) + body + struct.pack("<Q", 0) + apart

    begin = len(built([0] * len(counts)))
    return built([begin + int(n) for n in np.cumsum([0, *counts[:-1]])])


def write_tiffs(px: DataFrame, path: str, bands: list[str], tile: int = 256, bits: int = 8, compression: str = "deflate", predictor: bool = False, name: str = "slide") -> DataFrame:
    """A tiled BigTIFF for each name below path, of px (name, y, x, bands); returns name, path, tiles, bytes.

    An image reaches to its greatest y and x; pixels that aren't there are 0, as are null ones. Of several
    pixels at a place the greatest counts. Tiles are encoded in the tasks that group their pixels, and written; a
    file is then put together from its tiles by one task, a tile at a time, under a name of its own, and takes its
    own name when whole: a task that runs again changes nothing. Names must be fit for files. No pixels: no file.
    """
    spark, held = px.sparkSession, []
    path, samples = address(spark, path), len(bands)
    values = F.struct(*[F.coalesce(F.col(b), F.lit(0)).cast("int").alias(f"b{k}") for k, b in enumerate(bands)])
    at = px.select(F.col(name).cast("string").alias("name"), F.floor(F.col("y") / tile).cast("int").alias("ty"), F.floor(F.col("x") / tile).cast("int").alias("tx"), (F.col("y") % tile).cast("int").alias("dy"), (F.col("x") % tile).cast("int").alias("dx"), values.alias("v"))
    grouped = at.groupBy("name", "ty", "tx").agg(F.sort_array(F.collect_list(F.struct((F.col("dy") * tile + F.col("dx")).alias("at"), "v"))).alias("px"), F.max("dy").alias("dy"), F.max("dx").alias("dx"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1)
                own = row.column("px").flatten()
                place, v = own.field("at").to_numpy(), own.field("v")
                grid = np.zeros((tile * tile, samples), dtype=np.int64)
                for b in range(samples):
                    grid[place, b] = v.field(f"b{b}").to_numpy()
                data = encoded_tile(grid.reshape(tile, tile, samples), bits, compression, predictor)
                yield pa.RecordBatch.from_arrays([row.column(c) for c in ("name", "ty", "tx", "dy", "dx")] + [pa.array([data], pa.binary())], names=["name", "ty", "tx", "dy", "dx", "data"])

    tiles = cut(grouped.mapInArrow(encoded, "name string, ty int, tx int, dy int, dx int, data binary"), "tiles", held)
    # the directory needs every tile's size: small rows, one per tile
    sizes = tiles.groupBy("name").agg((F.max(F.col("ty") * tile + F.col("dy")) + 1).alias("h"), (F.max(F.col("tx") * tile + F.col("dx")) + 1).alias("w"), F.collect_list(F.struct("ty", "tx", F.length("data").alias("n"))).alias("own"))

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                across = -(-r["w"] // tile)
                counts = [0] * (-(-r["h"] // tile) * across)
                for t in r["own"]:
                    counts[t["ty"] * across + t["tx"]] = t["n"]
                yield pa.RecordBatch.from_pydict({"name": [r["name"]], "ty": [-1], "tx": [-1], "data": [header(r["h"], r["w"], samples, bits, compression, predictor, tile, counts)]}, schema=pa.schema([("name", pa.string()), ("ty", pa.int32()), ("tx", pa.int32()), ("data", pa.binary())]))

    pieces = tiles.select("name", "ty", "tx", "data").unionByName(sizes.mapInArrow(headed, "name string, ty int, tx int, data binary"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)
        fs.create_dir(base, recursive=True)
        now, out, part, n, size = None, None, "", 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            fs.move(part, f"{base}/{now}.tif")
            return pa.RecordBatch.from_pydict({"name": [now], "path": [f"{path.rstrip('/')}/{now}.tif"], "tiles": [n], "bytes": [size]})

        for batch in batches:
            for key, data in zip(batch.column("name").to_pylist(), batch.column("data"), strict=True):
                if key != now:
                    if out:
                        yield done()
                    now, part, n, size = key, f"{base}/.{key}-{uuid.uuid4().hex}", -1, 0
                    out = fs.open_output_stream(part)
                out.write(data.as_buffer())
                n, size = n + 1, size + len(data.as_buffer())
        if out:
            yield done()

    files = cut(pieces.repartition("name").sortWithinPartitions("name", "ty", "tx").mapInArrow(joined, "name string, path string, tiles long, bytes long"), "files")
    drop(spark, held)
    return files
