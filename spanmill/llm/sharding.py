"""Sharding by size-tiered compaction, in DataFrame functions only.

A shard set is a folder of immutable runs (Parquet folders) and numbered manifests. An arrival is
appended as a run of small shards; when enough runs of one size tier have gathered, they are merged
into one run of target-sized files. Each change is a new manifest, made under another name and
renamed to its number; the rename fails if that number is taken, so readers see whole versions only
and of two writers one tries again upon the other's version. Merged runs stay, and with them all older
versions and what was read from them, until expire() is called for those that nobody reads any more;
it also finds the folders that crashed writers left.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TARGET_BYTES = 128 << 20
SMALLEST_BYTES = 1 << 20
FAN_IN = 4
ARRIVALS = 16
#: Versions that arrive() keeps readable while it compacts.
RETAINED = 4
#: Folders of no version are taken for left by a crashed writer after so long.
ORPHAN_SECONDS = 24 * 3600


@dataclass(frozen=True)
class Run:
    """An immutable folder of shards."""

    path: str
    bytes: int
    tier: int


class ShardSet:
    """Runs and manifests below one folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, target_bytes: int = TARGET_BYTES, smallest_bytes: int = SMALLEST_BYTES, fan_in: int = FAN_IN):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.target_bytes, self.smallest_bytes, self.fan_in = target_bytes, smallest_bytes, fan_in
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path("manifests"))

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def versions(self) -> list[int]:
        """The numbers of the manifests that are there, ascending."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("manifests"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self) -> int:
        """The number of the latest manifest; 0 if there is none."""
        return max(self.versions(), default=0)

    def runs(self, version: int | None = None) -> list[Run]:
        """The runs of a version, the latest if none is given. A manifest lists folders, a few per size tier."""
        version = self.version() if version is None else version
        if not version:
            return []
        if not self._fs.exists(self._path(f"manifests/{version:010d}.json")):
            raise ValueError(f"there is no version {version}, or no longer")
        (line,) = (r.value for r in self.spark.read.text(f"{self.root}/manifests/{version:010d}.json").collect())
        return [Run(**r) for r in json.loads(line)["runs"]]

    def commit(self, runs: list[Run], after: int) -> int:
        """Make `runs` version after + 1; raises FileExistsError if another writer has made it."""
        jvm, version = self.spark._jvm, after + 1
        held, final = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/{version:010d}.json")
        out = self._fs.create(held, False)
        out.write(bytearray(json.dumps({"version": version, "runs": [asdict(r) for r in runs]}).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(held.toUri(), self.spark._jsc.hadoopConfiguration()) if held.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(held, final, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            self._fs.delete(held, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise FileExistsError(f"version {version} is taken") from e
            raise
        return version

    def tier(self, size: int) -> int:
        """0 for the smallest runs; each tier holds runs fan_in times as large as the last."""
        return max(0, round(math.log(max(size, 1) / self.smallest_bytes, self.fan_in)))

    def measured(self, path: str) -> Run:
        size = self._fs.getContentSummary(self.spark._jvm.org.apache.hadoop.fs.Path(path)).getLength()
        return Run(path, size, self.tier(size))

    def adopt(self, path: str) -> int:
        """Commit a folder of shards that is already written below the root as a new run, after whatever others commit."""
        new = self.measured(path)
        while True:
            at = self.version()
            try:
                return self.commit([*self.runs(at), new], at)
            except FileExistsError:
                continue

    def append(self, rows: DataFrame) -> int:
        """Write rows as small immutable shards and commit them."""
        rows.write.parquet(path := f"{self.root}/run-{uuid.uuid4().hex}")
        return self.adopt(path)

    def compact(self) -> int:
        """Merge runs of one tier, smallest tiers first, while fan_in or more stand in it; the version then.

        The runs merged stay for readers of older versions, until expire().
        """
        while True:
            at = self.version()
            runs = self.runs(at)
            full = [t for t in sorted({r.tier for r in runs}) if sum(r.tier == t for r in runs) >= self.fan_in]
            if not full:
                return at
            merged = [r for r in runs if r.tier == full[0]]
            files = max(1, math.ceil(sum(r.bytes for r in merged) / self.target_bytes))
            self.read_runs(merged).coalesce(files).write.parquet(path := f"{self.root}/run-{uuid.uuid4().hex}")
            new = self.measured(path)
            # a merged run stands above its parts even where it compresses better
            new = Run(new.path, new.bytes, max(new.tier, full[0] + 1))
            while True:  # others may append meanwhile; only if one of the runs is gone the merge was in vain
                try:
                    self.commit([*(r for r in runs if r not in merged), new], at)
                    break
                except FileExistsError:
                    at = self.version()
                    runs = self.runs(at)
                    if not set(merged) <= set(runs):
                        self._delete(path)
                        break

    def expire(self, keep: int = 1, orphan_seconds: float = ORPHAN_SECONDS) -> list[str]:
        """Drop all but the last `keep` versions and the runs that only they hold; the folders deleted.

        Manifests go before files, so no version that can be found lacks any. Folders that no version
        names (of a writer that crashed, or is still writing) go if unchanged for orphan_seconds.
        """
        there = self.versions()
        kept, dropped = there[-max(1, keep) :], there[: -max(1, keep)]
        needed = {r.path for v in kept for r in self.runs(v)}
        gone = {r.path for v in dropped for r in self.runs(v)} - needed
        for v in dropped:
            self._fs.delete(self._path(f"manifests/{v:010d}.json"), False)
        told = {self._plain(p) for p in needed | gone}
        before = (time.time() - orphan_seconds) * 1000
        for status in [s for d in self._fs.listStatus(self._path("")) if d.isDirectory() and d.getPath().getName() != "manifests" for s in (self._fs.listStatus(d.getPath()) if d.getPath().getName().startswith("arrivals-") else [d])]:
            path = self._plain(status.getPath().toString())
            if status.isDirectory() and path not in told and status.getModificationTime() <= before:
                gone.add(path)
        for path in gone:
            self._delete(path)
        return sorted(gone)

    def _plain(self, path: str) -> str:
        """A path as its file system writes it."""
        return self._fs.makeQualified(self.spark._jvm.org.apache.hadoop.fs.Path(path)).toString()

    def _delete(self, path: str) -> None:
        self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)

    def read_runs(self, runs: list[Run]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[r.path for r in runs]) if runs else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the latest if none is given."""
        return self.read_runs(self.runs(version))


def arrive(rows: DataFrame, key: str, root: str, arrivals: int = ARRIVALS, retain: int = RETAINED, **sizes: int) -> ShardSet:
    """Append rows in arrivals by a hash of the key, compacting after each and keeping the last `retain` versions.

    The arrivals are written in one pass, a folder each, and committed one by one. Null keys have a
    hash as well; repeated rows stay; a table without rows makes a set without runs.
    """
    spark = rows.sparkSession
    held = ShardSet(spark, root, T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema]), **sizes)
    part = f"__arrival_{uuid.uuid4().hex}"
    rows.withColumn(part, F.pmod(F.xxhash64(key), F.lit(arrivals))).write.partitionBy(part).parquet(arrived := f"{held.root}/arrivals-{uuid.uuid4().hex}")
    for status in sorted(held._fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(arrived)), key=lambda s: s.getPath().getName()):
        if status.isDirectory():
            held.adopt(status.getPath().toString())
            held.compact()
            held.expire(retain)
    return held


SQL = "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents"


def contents(held: ShardSet) -> DataFrame:
    """What the latest version of a set of documents holds."""
    return held.read().select("doc_id", "lang", "source", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
