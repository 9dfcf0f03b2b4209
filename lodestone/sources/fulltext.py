"""A stored inverted index: postings by ranges of terms, in segments that are added and merged."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import retrieval

#: Buckets of terms, a folder each; the number is part of the format.
BUCKETS = 64
POSTINGS = "bucket"


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class FullTextIndex:
    """An index in the folder ``path``, of texts by key (one column, or several such as evidence and revision).

    A segment has three tables: ``postings`` (bucket, term, *key, tf, length), in a folder for each
    bucket and sorted by term within files; ``terms`` (bucket, term, df); ``texts`` (*key, length).
    Buckets are dealt to tasks by ranges of bucket, term and key, so a term in every text is
    written by many tasks and lies in many files. A version of the manifest lists segments with their
    texts and words; it is made by a rename that fails where the version exists, so of two
    writers at once one raises, and readers see whole versions only.

    A search reads the folders of its terms' buckets, and of their files the row groups that may
    hold the terms. Texts are never changed: a revision is another key, and what holds as of a day
    is for the reader to say, by the keys that it passes.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str]) -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    # The manifest.

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _files(self):
        return self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest version; 0 before the first segment."""
        if not self._files().exists(self._at("manifest")):
            return 0
        return max((int(f.getPath().getName()[1:]) for f in self._files().listStatus(self._at("manifest"))), default=0)

    def segments(self, version: int | None = None) -> list[dict]:
        """What the manifest says: name, texts and words of each segment."""
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self._files().open(self._at("manifest", f"v{version:08d}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, segments: list[dict], version: int) -> None:
        files, draft = self._files(), self._at(f"draft-{uuid.uuid4().hex}")
        out = files.create(draft)
        try:
            out.write(json.dumps(segments).encode())
        finally:
            out.close()
        files.mkdirs(self._at("manifest"))
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at().toUri(), self.spark._jsc.hadoopConfiguration())
        keep = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, self._at("manifest", f"v{version:08d}"), keep)
        except Py4JJavaError as error:
            files.delete(draft, False)
            raise RuntimeError(f"version {version} is there already") from error

    # Writing.

    def _written(self, postings: DataFrame, texts: DataFrame) -> dict:
        """A segment's tables, and its line of the manifest."""
        name = uuid.uuid4().hex
        folder = f"{self.path}/segments/{name}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = postings.select(bucket(F.col("term")).alias(POSTINGS), "term", *self.key, "tf", "length")
        rows = rows.repartitionByRange(n, POSTINGS, "term", *self.key).sortWithinPartitions(POSTINGS, "term", *self.key)
        rows.write.partitionBy(POSTINGS).option("compression", "zstd").parquet(f"{folder}/postings")
        held = self.spark.read.parquet(f"{folder}/postings") if not rows.isEmpty() else rows
        held.groupBy(POSTINGS, "term").agg(F.count("*").alias("df")).write.parquet(f"{folder}/terms")
        texts.select(*self.key, "length").write.parquet(f"{folder}/texts")
        count, words = self.spark.read.parquet(f"{folder}/texts").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        return {"name": name, "texts": count, "words": words, "empty": bool(held is rows)}

    def add(self, docs: DataFrame, text: str, tokens: Column | None = None) -> int:
        """Indexes rows of ``docs`` whose key isn't there yet, and returns the new version.

        Of rows that repeat a key one is taken; null keys are no keys and raise. A null text has no
        words but counts as a text. ``tokens``: the words of a row, by default runs of word characters.
        """
        missing = docs.where(" or ".join(f"`{c}` is null" for c in self.key))
        if not missing.isEmpty():
            raise ValueError("a text has no key")
        version = self.version()
        words = (retrieval.word_array(F.col(text)) if tokens is None else tokens).alias("_w")
        new = docs.dropDuplicates(self.key).select(*self.key, words)
        for s in self.segments(version):
            new = new.join(self._table(s, "texts").select(*self.key), self.key, "left_anti")
        # Written with its words, as several tables are made of it.
        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        new.withColumn("length", F.size("_w")).write.option("compression", "zstd").parquet(staged)
        new = self.spark.read.parquet(staged)
        per_term = new.select(*self.key, "length", F.explode("_w").alias("term")).groupBy(*self.key, "length", "term").agg(F.count("*").alias("tf"))
        segment = self._written(per_term, new)
        self._files().delete(self._at("staged", staged.rsplit("/", 1)[1]), True)
        self._commit([*self.segments(version), segment], version + 1)
        return version + 1

    def merge(self, most: int = 4) -> int:
        """Makes the smallest segments one while there are over ``most``; returns the version that holds.

        As in size tiers, the segments that are merged are those of the fewest words, as many as
        leave ``most``, so large ones are rewritten rarely; one that only empty ones join isn't. Replaced segments stay for readers of
        earlier versions until ``vacuum``.
        """
        version = self.version()
        held = sorted(self.segments(version), key=lambda s: s["words"])
        if len(held) <= most:
            return version
        old, kept = held[: len(held) - most + 1], held[len(held) - most + 1 :]
        filled = [s for s in old if s["texts"]]
        if len(filled) < 2:  # nothing to join: those without texts go
            self._commit([*kept, *(filled or old[:1])], version + 1)
            return version + 1
        postings, texts = (self._union(old, t) for t in ("postings", "texts"))
        self._commit([*kept, self._written(postings, texts)], version + 1)
        return version + 1

    def vacuum(self) -> int:
        """Deletes segments that the newest version hasn't, and says how many; no add or merge may be running."""
        live, files = {s["name"] for s in self.segments()}, self._files()
        gone = [f.getPath() for f in (files.listStatus(self._at("segments")) if live else []) if f.getPath().getName() not in live]
        return sum(files.delete(p, True) for p in gone)

    # Reading.

    def _table(self, segment: dict, name: str) -> DataFrame:
        folder = f"{self.path}/segments/{segment['name']}"
        if name == "postings" and segment["empty"]:
            keys = self.spark.read.parquet(f"{folder}/texts").select(*self.key)
            return keys.limit(0).select(F.lit(0).alias(POSTINGS), F.lit("").alias("term"), *self.key, F.lit(0).cast("long").alias("tf"), F.lit(0).alias("length"))
        return self.spark.read.parquet(f"{folder}/{name}")

    def _union(self, segments: list[dict], name: str) -> DataFrame:
        found = None
        for s in segments:
            found = self._table(s, name) if found is None else found.unionByName(self._table(s, name))
        return found

    def postings(self, terms: list[str], version: int | None = None) -> DataFrame:
        """(bucket, term, *key, tf, length) of some terms: only their buckets' folders are listed."""
        wanted = sorted(set(terms))
        spots = sorted({int(r[0]) for r in self.spark.createDataFrame([(t,) for t in wanted], "t string").select(bucket(F.col("t"))).collect()}) if wanted else []
        return self._union(self.segments(version), "postings").where(F.col(POSTINGS).isin(spots) & F.col("term").isin(wanted))

    def search(self, terms: list[str], current: DataFrame | None = None, version: int | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(*key, score) of texts that hold all ``terms``, by BM25 over the whole index.

        ``current``: the keys that count, such as the revisions that hold as of a day; weights
        stay those of all texts that are indexed. No terms find nothing.
        """
        held = self.segments(version)
        wanted = sorted(set(terms))
        if not held or not wanted:
            raise LookupError("nothing is indexed") if not held else ValueError("no terms")
        texts, words = sum(s["texts"] for s in held), sum(s["words"] for s in held)
        hits = self.postings(wanted, version)
        stored = self._union([s for s in held if not s["empty"]] or held, "terms").where(F.col("term").isin(wanted))
        df = {r.term: r.df for r in stored.groupBy("term").agg(F.sum("df").alias("df")).collect()}  # a row per term that is asked for
        if current is not None:
            hits = hits.join(current.select(*self.key).distinct(), self.key, "left_semi")
        n = F.create_map(*[x for t in wanted for x in (F.lit(t), F.lit(float(df.get(t, 0))))])[F.col("term")]
        idf = F.log((F.lit(float(texts)) - n + 0.5) / (n + 0.5) + 1)
        weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(words / texts or 1.0)))
        scored = hits.groupBy(*self.key).agg(F.count("*").alias("_n"), F.sum(idf * weight).alias("score"))
        return scored.where(F.col("_n") == len(wanted)).select(*self.key, "score")
