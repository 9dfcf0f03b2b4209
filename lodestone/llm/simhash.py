"""SimHash near-duplicate detection with multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialise, spread
from lodestone.llm.components import connected_components

#: Shingles whose bits are counted at once, so that a very long text needs bounded memory.
BLOCK = 1 << 15
#: Fingerprints of one segment bucket that a task holds at once; larger buckets are split.
BUCKET = 1024
#: Buckets of over so many fingerprints are cut by the bits of the other segments first.
HUGE = 32 * BUCKET
#: Fingerprint pairs that are compared in one vectorised step.
PAIRS = 1 << 18


def simhash64(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of a whole text, by word shingles and XXH64.

    A-Z are lower-cased, words are runs without ASCII white space, and shingles count as often
    as they occur. A text with fewer words than a shingle is one shingle; null and texts
    without a word give 0.
    """
    tokens = text.encode("utf-8", "replace").lower().split() if text else []
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    end = np.cumsum(size + 1) - 1
    first = (end - size)[: len(tokens) - shingle + 1].tolist()
    last = end[shingle - 1 :].tolist()
    digest, n = xxhash.xxh64_intdigest, len(first)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, BLOCK):
        spans = zip(first[k : k + BLOCK], last[k : k + BLOCK], strict=True)
        h = np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64)
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def with_fingerprint(
    docs: DataFrame, text: str = "text", out: str = "fingerprint", shingle: int = 4, seed: int = 42
) -> DataFrame:
    """``docs`` with the SimHash of ``text`` as a signed long."""

    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        prints = np.fromiter((simhash64(t, shingle, seed) for t in texts), np.uint64, len(texts))
        return pd.Series(prints.view(np.int64))

    return docs.withColumn(out, fingerprint(F.col(text)))


def segments(radius: int, parts: int, bits: int = 64) -> list[tuple[int, int, int]]:
    """(shift, width, ball radius) of each segment.

    With radius = parts * a + b, two prints within ``radius`` are within a bits of each other in
    one of the first b + 1 segments, or within a - 1 in one of the others.
    """
    a, b = divmod(radius, parts)
    widths = [bits // parts + (k < bits % parts) for k in range(parts)]
    shifts = [sum(widths[k + 1 :]) for k in range(parts)]
    return [(s, w, a if k <= b else a - 1) for k, (s, w) in enumerate(zip(shifts, widths, strict=True))]


def _ball(width: int, radius: int) -> list[int]:
    """All masks of at most ``radius`` set bits."""
    masks, layer = [0], [(0, -1)]
    for _ in range(radius):
        layer = [(m | 1 << k, k) for m, top in layer for k in range(top + 1, width)]
        masks += [m for m, _ in layer]
    return masks


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes as a-b do, at most one for each node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        ru, rv = root[u], root[v]
        low = np.minimum(ru, rv)
        new = root.copy()
        np.minimum.at(new, ru, low)
        np.minimum.at(new, rv, low)
        while not np.array_equal(new[new], new):
            new = new[new]
        if np.array_equal(new, root):
            moved = root != np.arange(len(nodes))
            return nodes[moved], nodes[root[moved]]
        root = new


def _links(radius: int):
    """Rows (cell, fp, probe), sorted so that a cell's table rows come first, to links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_cell, held_fp = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            cell, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            probe = batch.column(2).to_numpy(zero_copy_only=False)
            t_cell, t_fp = np.append(held_cell, cell[~probe]), np.append(held_fp, fp[~probe])
            p_cell, p_fp = cell[probe], fp[probe]
            low, high = np.searchsorted(t_cell, p_cell), np.searchsorted(t_cell, p_cell, "right")
            total = np.cumsum(high - low)
            found_a, found_b, k = [], [], 0
            while k < len(p_fp):
                before = total[k - 1] if k else 0
                end = max(k + 1, int(np.searchsorted(total, before + PAIRS, "right")))
                n = (high - low)[k:end]
                first = np.repeat(low[k:end] - (np.cumsum(n) - n), n)
                a, b = np.repeat(p_fp[k:end], n), t_fp[first + np.arange(len(first))]
                near = (a < b) & (np.bitwise_count((a ^ b).view(np.uint64)) <= radius)
                if near.any():
                    x, y = _forest(a[near], b[near])
                    found_a.append(x)
                    found_b.append(y)
                k = end
            if found_a:
                x, y = _forest(np.concatenate(found_a), np.concatenate(found_b))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])
            if len(cell):  # the last cell may go on in the next batch
                same = t_cell == cell[-1]
                held_cell, held_fp = t_cell[same], t_fp[same]

    return run


def _cut(table: DataFrame, probes: DataFrame, plan: list[tuple[int, int, int]], radius: int) -> tuple[DataFrame, DataFrame]:
    """``table`` and ``probes`` (fp, cell) with huge cells cut by segments of the other bits, as hashes.

    What collides with another cell's hash is compared in vain, and dropped like any other pair
    that isn't near.
    """
    counts = table.groupBy("cell").count().where(F.col("count") > HUGE).select(F.col("cell").alias("huge"))
    counts = materialise(counts, "huge")
    if counts.isEmpty():
        return table, probes

    def cells(balls: bool):
        options = []
        for k, (shift, width, _) in enumerate(plan):
            low = F.col("fp").bitwiseAND(F.lit((1 << shift) - 1))
            high = F.shiftrightunsigned("fp", shift + width) if shift + width < 64 else F.lit(0).cast("long")
            rest = F.shiftleft(high, shift).bitwiseOR(low)  # the bits that aren't the bucket's
            found = []
            for j, (s, w, r) in enumerate(segments(radius, 3, 64 - width)):
                value = F.shiftrightunsigned(rest, s).bitwiseAND(F.lit((1 << w) - 1))
                for m in (_ball(w, r) if r >= 0 else []) if balls else [0]:
                    found.append(F.xxhash64("cell", F.lit(j), value.bitwiseXOR(F.lit(m))))
            options.append((F.shiftright("cell", 56) == k, F.array(*found)))
        rule = F.when(*options[0])
        for o in options[1:]:
            rule = rule.when(*o)
        return rule

    def step(rows: DataFrame, balls: bool) -> DataFrame:
        joined = rows.join(counts, F.col("cell") == F.col("huge"), "left")
        return joined.select("fp", F.explode(F.when(F.col("huge").isNull(), F.array("cell")).otherwise(cells(balls))).alias("cell"))

    return step(table, False), step(probes, True)


def _dealt(table: DataFrame, probes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``table`` and ``probes`` with cells of over ``BUCKET`` prints dealt over blocks, each of which a probe visits."""
    dense = materialise(
        table.groupBy("cell").count().where(F.col("count") > BUCKET)
        .select("cell", F.ceil(F.col("count") / BUCKET).alias("blocks")),
        "dense",
    )
    n_dense = dense.count()
    if not n_dense:
        return table, probes
    few = F.broadcast(dense) if n_dense <= 50_000 else dense
    table = table.join(few, "cell", "left").select(
        "fp", (F.col("cell") + F.coalesce(F.pmod(F.xxhash64("fp"), "blocks"), F.lit(0))).alias("cell")
    )
    blocks = F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1)
    return table, probes.join(few, "cell", "left").select("fp", F.explode(F.transform(blocks, lambda b: F.col("cell") + b)).alias("cell"))


def near_links(prints: DataFrame, radius: int = 4, parts: int = 3) -> DataFrame:
    """Links ``(a, b)`` that connect exactly what pairs within ``radius`` bits connect.

    ``prints`` holds distinct long ``fp``. Multi-index hashing: each print lies in one bucket
    per segment and looks into the buckets of the small Hamming ball around its own segment
    value; what it meets there is verified over all 64 bits. A bucket of over ``HUGE`` prints is
    cut once more in the same way, by segments of the bits that its prints don't share; one of
    over ``BUCKET`` is dealt over several cells, and every print that looks into it visits each
    of them, so no task holds a large bucket. Of the verified pairs, each task keeps a spanning forest: output
    grows with the prints, not with the square of a dense group, and no connection is lost.

    Three segments make 46 keys of 21 or 22 bits a print, which suits up to some 10**9 prints;
    two make 563 of 32 bits, for more. The links connect the same either way.
    """
    spark = prints.sparkSession
    plan = segments(radius, parts)
    if max(w for _, w, _ in plan) > 36:
        raise ValueError("segments of over 36 bits have too large balls: take more parts")

    def keyed(masks: list[list[int]]) -> DataFrame:
        cells = []
        for k, (shift, width, _) in enumerate(plan):
            value = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
            for m in masks[k]:  # 20 low bits for the blocks of a split bucket
                cells.append(F.lit(k << 56) + F.shiftleft(value.bitwiseXOR(F.lit(m)), 20))
        return prints.select("fp", F.explode(F.array(*cells)).alias("cell"))

    table = keyed([[0] for _ in plan])
    probes = keyed([_ball(w, r) if r >= 0 else [] for _, w, r in plan])
    table, probes = _dealt(*_cut(table, probes, plan, radius))
    rows = table.select("cell", "fp", F.lit(False).alias("probe")).union(
        probes.select("cell", "fp", F.lit(True).alias("probe"))
    )
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = rows.repartition(n, "cell").sortWithinPartitions("cell", "probe")
    return rows.mapInArrow(_links(radius), "a long, b long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    radius: int = 4,
    shingle: int = 4,
    seed: int = 42,
) -> DataFrame:
    """``(id, fingerprint hex, component_id)`` of every row of ``docs``.

    Prints within ``radius`` differing bits are linked; ``component_id`` is the least id that
    links reach, the row's own included. Null ids stay null and never name a component that
    has another id. Texts that are null or without a word have print 0 and are linked like any
    other. Repeated rows are returned as often as they occur; other columns are not read.
    """
    hashed = materialise(
        with_fingerprint(spread(docs.select(F.col(id_col).alias("id"), F.col(text).alias("t"))), "t", "fp", shingle, seed)
        .select("id", "fp"),
        "prints",
    )
    groups = group_ids(hashed, radius)
    return hashed.join(groups, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("least").alias("component_id"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = 4) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: that of the least id.

    Of several rows with that id one stays; null ids come after all others.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    hashed = materialise(
        with_fingerprint(spread(docs).select(whole, F.col(text).alias("t"), F.monotonically_increasing_id().alias("row")), "t", "fp")
        .drop("t"),
        "prints",
    )
    key = F.col("doc").getField(id_col)
    groups = group_ids(hashed.select("fp", F.struct(key.isNull(), key, "row").alias("id")), radius)
    first = groups.select(F.col("least.row").alias("row")).distinct()
    return hashed.join(first, "row", "left_semi").select("doc.*")


def group_ids(hashed: DataFrame, radius: int = 4) -> DataFrame:
    """``(id, fp)`` rows to one ``(fp, least)`` row per print: the least id of its component."""
    prints = materialise(hashed.groupBy("fp").agg(F.min("id").alias("id")), "classes")
    roots = connected_components(near_links(prints.select("fp"), radius))
    named = materialise(
        prints.join(roots, prints.fp == roots.node, "left").select(
            "fp", "id", F.coalesce("root", "fp").alias("root")
        ),
        "roots",
    )
    # Written, so that the join below is a plain one: a root with many prints is then a hot key that Spark splits.
    least = materialise(named.groupBy("root").agg(F.min("id").alias("least")), "least")
    return named.join(least, "root").select("fp", "least")
