"""Media columns: content-defined chunks, stored once, that ordered lists put together again."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialise, new_path, spread
from lodestone.llm.files import create, read_spans

#: Bytes of media that a task puts together at once.
AT_ONCE = 32 << 20
#: Media values of a pack that are read in one run.
ROWS = 1024
GEAR = np.random.default_rng(9).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling_gear(data: np.ndarray) -> np.ndarray:
    """Gear hash of the 32 bytes up to each position: sum of gear[byte k back] << k, mod 2**32."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):  # a window of 2k is two windows of k
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


def cut_points(data: bytes, least: int = 1 << 10, target_bits: int = 12, most: int = 1 << 14) -> list[int]:
    """Ends of the chunks: where the hash's top bits are 0, within the size limits."""
    hits = np.flatnonzero(rolling_gear(np.frombuffer(data, np.uint8)) < np.uint32(1 << (32 - target_bits))) + 1
    ends, start, n = [], 0, len(data)
    while n - start > most or (n - start > least and len(hits)):
        k = np.searchsorted(hits, start + least)
        end = min(int(hits[k]) if k < len(hits) else n, start + most)
        ends.append(end)
        start = end
        hits = hits[k:]
        if start == n:
            return ends
    return [*ends, n] if start < n else ends


def payload(text: str | None, unit: int) -> tuple[int, bytes]:
    """Length of the UTF-8 bytes, and these with bytes 0 up to a positive multiple of ``unit``."""
    data = (text or "").encode("utf-8", "replace")
    return len(data), data.ljust(max(unit, -(-len(data) // unit) * unit), b"\0")


def write_chunks(media: DataFrame, folder: str, key: str, text: str, unit: int = 64, level: int = 3) -> DataFrame:
    """Stores the payload of every row in pack files, a row per chunk: where it was put.

    A task writes one pack, and a chunk that the task has seen before not again. Columns: part,
    row (unique with part), key, n_bytes, nth, digest, size, pack, offset, stored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, offset, seen = TaskContext.get().partitionId(), 0, 0, {}
        name = f"pack-{part}-{uuid.uuid4().hex[:12]}"
        squeeze = zstandard.ZstdCompressor(level=level).compress
        pack = None
        try:
            for batch in batches:
                out = []
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    n, data = payload(t.as_py(), unit)
                    start = 0
                    for nth, end in enumerate(cut_points(data)):
                        chunk = data[start:end]
                        digest = hashlib.sha256(chunk).digest()
                        if digest not in seen:
                            stored = squeeze(chunk)
                            pack = pack or create(folder, name)
                            pack.write(stored)
                            seen[digest] = (offset, len(stored))
                            offset += len(stored)
                        out.append((part, row, k, n, nth, digest, end - start, name, *seen[digest]))
                        start = end
                    row += 1
                if out:
                    columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                    columns[2] = columns[2].cast(batch.schema.field(0).type)
                    yield pa.RecordBatch.from_arrays(columns, names=names)
        finally:
            if pack:
                pack.close()

    i, s, b = pa.int64(), pa.string(), pa.binary()
    kinds = (pa.int32(), i, None, i, pa.int32(), b, pa.int32(), s, i, pa.int32())
    names = ["part", "row", key, "n_bytes", "nth", "digest", "size", "pack", "offset", "stored"]
    schema = f"part int, row long, `{key}` {media.schema[key].dataType.simpleString()}, n_bytes long, nth int, digest binary, size int, pack string, offset long, stored int"
    return materialise(spread(media.select(key, text)).mapInArrow(run, schema), "chunks")


def recipes(chunks: DataFrame, key: str) -> DataFrame:
    """A row per media value: the ordered list of its chunks, each at the one place that counts.

    Of equal chunks in several packs the first by (pack, offset) counts, and only that is ever
    read. A task stores a chunk once, so one that many tasks meet is stored at most once a task.
    Rows stay with their pack in runs of ``ROWS``, so that a task reads few packs and no pack
    waits for one task.
    """
    place = F.min(F.struct("pack", "offset", "stored")).alias("at")
    # Written, so that a digest with many chunks is a plain join's hot key, which Spark splits.
    canonical = materialise(chunks.groupBy("digest").agg(place), "canonical")
    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        chunks.select("part", "row", key, "n_bytes", "nth", "digest", "size")
        .join(canonical, "digest")
        .withColumn("run", F.floor(F.col("row") / ROWS))
        .repartition(n, "part", "run")
        .groupBy("part", "run", "row")
        .agg(
            F.first(key).alias(key),
            F.first("n_bytes").alias("n_bytes"),
            F.sort_array(F.collect_list(F.struct("nth", "at.pack", "at.offset", "at.stored", "digest"))).alias("parts"),
            F.sum("size").alias("size"),
        )
    )


def features(data: bytes, parts: int) -> str:
    """Of 8-bit samples: chunks, mean, peak, entropy in bits."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = counts[counts > 0] / len(data)
    mean = float(counts @ np.arange(256)) / len(data)
    return f"chunks={parts};mean={mean:.4f};peak={int(np.flatnonzero(counts)[-1])};entropy={-float(p @ np.log2(p)):.4f}"


def read_media(lists: DataFrame, folder: str, key: str, tail: int = 64, with_bytes: bool = False) -> DataFrame:
    """Reads chunks back, checks each digest, puts every payload together and describes it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows, first, n = batch.to_pylist(), 0, 0
            for k, r in enumerate(rows):
                n += r["size"]
                if n >= AT_ONCE or k == len(rows) - 1:
                    yield assembled(rows[first : k + 1], expand, batch.schema.field(0).type)
                    first, n = k + 1, 0

    def assembled(rows: list[dict], expand, kind: pa.DataType) -> pa.RecordBatch:
        found = read_spans(folder, ((p["pack"], p["offset"], p["stored"]) for r in rows for p in r["parts"]))
        out = []
        for r in rows:
            chunks = [expand(found[p["pack"], p["offset"]]) for p in r["parts"]]
            if any(hashlib.sha256(c).digest() != p["digest"] for c, p in zip(chunks, r["parts"], strict=True)):
                raise ValueError("a stored chunk doesn't have its digest")
            data = b"".join(chunks)
            sha = hashlib.sha256(data[: r["size"]]).hexdigest()
            row = (r[key], r["n_bytes"], r["size"], sha, zlib.crc32(data[-tail:]), len(data), hashlib.sha256(data).hexdigest(), features(data, len(chunks)))
            out.append(row + (data,) * with_bytes)
        kinds = (kind, i, i, s, i, i, s, s, *[pa.binary()] * with_bytes)
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    i, s = pa.int64(), pa.string()
    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *["media"] * with_bytes]
    schema = f"`{key}` {lists.schema[key].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * with_bytes
    return lists.select(key, "n_bytes", "size", "parts").mapInArrow(run, schema)


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: int = 64, with_bytes: bool = False) -> DataFrame:
    """Stores every text as 8-bit samples in content-defined chunks, and reads it back.

    The stored form is the raw run of samples that a row's chunk list spells; chunks are
    compressed in the packs, losslessly. Null texts are empty and give one padded block.
    Repeated rows and null keys give a row each; equal texts give equal values.
    """
    folder = new_path(docs.sparkSession, "packs")
    return read_media(recipes(write_chunks(docs, folder, key, text, unit), key), folder, key, unit, with_bytes)
