"""Size-tiered shards with a versioned manifest."""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

SCHEMA_FILE = "_schema.json"
#: Names of columns that reading a store adds or asks Spark for.
TAKEN = ("_shard", "_metadata")


def merged_schema(old: StructType | None, new: StructType) -> StructType:
    """The columns of ``old``, then those that only ``new`` has, all nullable.

    Raises where types differ, where names differ by case alone, and for names that the store needs.
    """
    kinds = {f.name: f.dataType for f in old or ()}
    for f in new:
        if f.name.lower() in TAKEN:
            raise ValueError(f"column {f.name}: the store needs this name")
        if f.name not in kinds and f.name.lower() in {name.lower() for name in kinds}:
            raise ValueError(f"column {f.name}: there is one that differs by case alone")
        if kinds.setdefault(f.name, f.dataType).jsonValue() != f.dataType.jsonValue():
            raise ValueError(f"column {f.name} was {kinds[f.name].simpleString()} and comes as {f.dataType.simpleString()}")
    return StructType([StructField(name, kind, True) for name, kind in kinds.items()])


def runs(shards: list[tuple[str, int]], target: int) -> list[list[str]]:
    """(shard, bytes), in order, cut into runs of about ``target`` bytes: each becomes one file."""
    out: list[list[str]] = []
    held = 0
    for name, size in shards:
        if not out or held + size / 2 > target:
            out.append([])
            held = 0
        out[-1].append(name)
        held += size
    return out


def stored_at() -> Column:
    """Where a row of a shard is stored, below the store's base."""
    return F.array_join(F.slice(F.split("_metadata.file_path", "/"), -3, 3), "/")


class ShardStore:
    """Immutable Parquet shards below ``base``, listed by the newest manifest.

    ``append`` writes arrivals as small shards, ``compact`` merges tiers of ``fanout`` or more
    shards of similar size into files of about ``target`` bytes, and each commits one new
    version of the manifest by a rename that fails where the version exists: readers see a
    version whole or not at all. An append that finds its version taken commits on top of the
    newer one; a compaction must start again. The driver handles the list of shards, never rows
    of data. Nothing is deleted but by ``vacuum``.

    A version has a schema: the columns of all appends so far by name. Shards without a column
    give nulls. A column that comes with another type, or in another case, is refused, and so
    are the names in ``TAKEN``.
    """

    def __init__(self, spark: SparkSession, base: str, target: int = 128 << 20, fanout: int = 4, smallest: int = 1 << 20):
        self.spark, self.base, self.target, self.fanout, self.smallest = spark, base.rstrip("/"), target, fanout, smallest

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.base, *parts]))

    def _files(self):
        path = self._path()
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, *parts: str) -> list:
        files, folder = self._files(), self._path(*parts)
        return list(files.listStatus(folder)) if files.exists(folder) else []

    def version(self) -> int:
        """The newest committed version; 0 before the first commit."""
        names = [s.getPath().getName() for s in self._listed("manifest")]
        return max((int(n[1:]) for n in names if n.startswith("v")), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """(shard, bytes, rows, tier, added) of a version: path below base, size, and so on."""
        version = self.version() if version is None else version
        schema = "shard string, bytes long, rows long, tier int, added long"
        if not version:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.base}/manifest/v{version:08d}")

    def schema(self, version: int | None = None) -> StructType | None:
        """The columns of a version; None before the first commit."""
        version = self.version() if version is None else version
        if not version:
            return None
        stream = self._files().open(self._path("manifest", f"v{version:08d}", SCHEMA_FILE))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return StructType.fromJson(json.loads(text))

    def _tier(self, size):
        """Tiers widen by ``fanout``; everything up to ``smallest`` bytes is tier 0."""
        return F.greatest(F.lit(0), F.ceil(F.log(size / F.lit(float(self.smallest))) / math.log(self.fanout))).cast("int")

    @contextmanager
    def _registered(self) -> Iterator[str]:
        """A name for folders of data, registered as being written until its manifest is committed or given up."""
        name, files = uuid.uuid4().hex, self._files()
        files.create(self._path("writing", name)).close()
        try:
            yield name
        finally:
            files.delete(self._path("writing", name), False)

    def _written(self, parts: list[DataFrame], name: str, added: int) -> DataFrame:
        """Writes each part to a folder of its own, and describes the shards that hold rows.

        Parts are jobs that run at once: a union would put parts of one partition into one task.
        """
        folders = [f"{self.base}/data/{name}-{k}" for k in range(len(parts))]
        write = lambda part, folder: part.write.option("compression", "zstd").parquet(folder)
        with ThreadPoolExecutor(max(1, min(len(parts), self.spark.sparkContext.defaultParallelism))) as pool:
            list(pool.map(write, parts, folders))
        kept = self.spark.read.schema(parts[0].schema).parquet(*folders)
        return kept.groupBy(stored_at().alias("shard"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows")).select(
            "shard", "bytes", "rows", self._tier(F.col("bytes")).alias("tier"), F.lit(added).cast("long").alias("added")
        )

    def commit(self, shards: DataFrame, version: int, schema: StructType | None = None) -> None:
        """Makes ``shards`` version ``version``, or raises where that exists."""
        draft = f"draft-{uuid.uuid4().hex}"
        shards.coalesce(1).write.parquet(f"{self.base}/{draft}")
        schema = schema or self.schema(version - 1)
        jvm = self.spark._jvm
        files = self._files()
        if schema is not None:
            out = files.create(self._path(draft, SCHEMA_FILE))
            try:
                out.write(schema.json().encode())
            finally:
                out.close()
        files.mkdirs(self._path("manifest"))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), self.spark._jsc.hadoopConfiguration())
        keep = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self._path(draft), self._path("manifest", f"v{version:08d}"), keep)
        except Py4JJavaError as error:
            files.delete(self._path(draft), True)
            raise RuntimeError(f"version {version} is there already") from error

    def append(self, rows: DataFrame) -> int:
        """Adds arrivals as the shards their partitions make; returns the new version.

        Raises ValueError, before anything is written, where a column has another type than before.
        """
        version = self.version()
        schema = merged_schema(self.schema(version), rows.schema)
        with self._registered() as name:
            shards = self._written([rows], name, version + 1)
            while True:
                try:
                    self.commit(self.manifest(version).unionByName(shards), version + 1, schema)
                    return version + 1
                except RuntimeError:
                    version = self.version()
                    schema = merged_schema(self.schema(version), rows.schema)
                    shards = shards.withColumn("added", F.lit(version + 1).cast("long"))

    def compact(self) -> int:
        """Merges tiers until none has ``fanout`` shards below half the target size.

        A merge cuts the tier's shards, in order of arrival, into runs of about ``target``
        bytes; each is a job of one task that writes one file, without a shuffle.
        """
        while True:
            version = self.version()
            live = self.manifest(version)
            small = live.where(F.col("bytes") < self.target // 2)
            full = small.groupBy("tier").agg(F.count("*").alias("n"), F.collect_list(F.struct("added", "shard", "bytes")).alias("shards"))
            tier = full.where(F.col("n") >= self.fanout).orderBy("tier").limit(1).collect()
            if not tier:
                return version
            schema = self.schema(version)
            files = runs([(s.shard, s.bytes) for s in sorted(tier[0]["shards"])], self.target)
            parts = [self.spark.read.schema(schema).parquet(*(f"{self.base}/{s}" for s in run)).coalesce(1) for run in files]
            rest = live.where((F.col("bytes") >= self.target // 2) | (F.col("tier") != tier[0]["tier"]))
            with self._registered() as name:
                merged = self._written(parts, name, version + 1)
                self.commit(rest.unionByName(merged), version + 1, schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with ``_shard``: where each is stored.

        A store without rows gives none, with the columns of what was appended; one to which
        nothing was ever appended has no columns, and raises.
        """
        version = self.version() if version is None else version
        schema = self.schema(version)
        if schema is None:
            raise ValueError("nothing was appended")
        shards = [r.shard for r in self.manifest(version).select("shard").collect()]
        if not shards:
            return self.spark.createDataFrame([], schema).withColumn("_shard", F.lit(None).cast("string"))
        rows = self.spark.read.schema(schema).parquet(*(f"{self.base}/{s}" for s in shards))
        return rows.withColumn("_shard", stored_at())

    def vacuum(self, abandoned: float = 7 * 86400.0) -> int:
        """Deletes shards that the newest version doesn't list; returns how many.

        What an append or merge that still runs has written stays: its folder is registered
        before the first file is, and until its version is committed. Registrations older than
        ``abandoned`` seconds are those of lost drivers and no longer count.
        """
        # Files first, then registrations, then the manifest: what is seen and no longer registered is committed or given up.
        seen = [(f"data/{folder.getPath().getName()}", file) for folder in self._listed("data") for file in self._listed("data", folder.getPath().getName())]
        oldest = (time.time() - abandoned) * 1000
        writing = {s.getPath().getName() for s in self._listed("writing") if s.getModificationTime() >= oldest}
        live = {r.shard for r in self.manifest().select("shard").collect()}
        files, gone = self._files(), 0
        for folder, file in seen:
            name = file.getPath().getName()
            if folder.removeprefix("data/").rpartition("-")[0] not in writing and name.endswith(".parquet") and f"{folder}/{name}" not in live:
                gone += files.delete(file.getPath(), False)
        return gone
