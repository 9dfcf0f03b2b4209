"""Best-fit packing of tokenised documents into sequences, after Martello-Toth reduction."""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm.common import materialise, spread

Bins = list[tuple[tuple[tuple[int, int], ...], int]]


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    """A byte-level BPE from a file of ranks; once per Python worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def ids_of(path: str, pattern: str, whole: str | None = None) -> Callable[[str], np.ndarray]:
    """Ids of a text, as the unmodified tokenizer of the file ``whole`` gives them; once per Python worker.

    The ranks give the same ids faster, but know no added tokens, and their pattern fails on
    about a million white-space characters in a row: such texts go to the tokenizer itself.
    Without ``whole``, added tokens are spelt as any text, and such runs raise.
    """
    encode = encoder(path, pattern).encode_to_numpy
    if whole is None:
        return lambda text: encode(text, disallowed_special=())
    tokenizer = Tokenizer.from_file(whole)
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def ids(text: str) -> np.ndarray:
        if not any(t in text for t in added):
            try:
                return encode(text, disallowed_special=())
            except ValueError:  # the pattern's stack is too small for the text
                pass
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    return ids


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; of several, only the first may be short."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((k, capacity) for k in range(first, n, capacity))]


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[Bins, dict[int, int]]:
    """Martello and Toth's reduction on a histogram of lengths: fixed bins, and what remains.

    A set {j} or {j, k} is fixed where every other set with j that fits could be exchanged for
    it: nothing fits beside j; k fills the bin; k is the largest that fits and no two others fit
    together; or no three others fit and no two that fit weigh more than k. Equal lengths are
    fixed together, so the work depends on the number of lengths alone.
    """
    left = {k: n for k, n in counts.items() if n > 0}
    fixed: Bins = []

    def take(sizes: list[int], times: int) -> None:
        fixed.append((tuple((x, sizes.count(x)) for x in sorted(set(sizes), reverse=True)), times))
        for x in sizes:
            left[x] -= times
            if not left[x]:
                del left[x]

    changed = True
    while changed:
        changed = False
        for j in sorted(left, reverse=True):
            while left.get(j):
                room = capacity - j
                rest = [(x, left[x] - (x == j)) for x in sorted(left) if x <= room and left[x] > (x == j)]
                if not rest:
                    take([j], left[j] if j > room else 1)
                    changed = True
                    continue
                k = rest[-1][0]
                times = left[j] // 2 if k == j else min(left[j], left[k])
                least = [x for x, n in rest[:3] for _ in range(min(n, 3))][:3]
                pair = len(least) > 1 and sum(least[:2]) <= room
                triple = len(least) > 2 and sum(least) <= room
                if k == room or not pair or (not triple and _best_pair(rest, room) <= k):
                    take([j, k], times)
                    changed = True
                else:
                    break
    return fixed, left


def _best_pair(rest: list[tuple[int, int]], room: int) -> int:
    best, low, high = 0, 0, len(rest) - 1
    while low <= high:
        both = rest[low][0] + rest[high][0]
        if low == high and rest[low][1] < 2:
            break
        if both <= room:
            best = max(best, both)
            low += 1
        else:
            high -= 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> Bins:
    """Best-fit decreasing on a histogram: bins of equal content are filled together."""
    open_bins: dict[int, list[list]] = defaultdict(list)  # by free room: [content, bins]
    rooms: list[int] = []
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect_right(rooms, size - 1)
            room = rooms[at] if at < len(rooms) else capacity
            group = open_bins[room].pop() if at < len(rooms) else [(), -(-left // (capacity // size))]
            if at < len(rooms) and not open_bins[room]:
                del open_bins[room], rooms[at]
            content, bins = group
            each = room // size
            full = min(bins, left // each)
            parts = [(full, each)] + ([(1, left % each)] if full < bins and left % each else [])
            used = 0
            for n, times in parts:
                if n:
                    _put(open_bins, rooms, room - times * size, [(*content, (size, times)), n])
                    left -= n * times
                    used += n
            if used < bins and content:
                _put(open_bins, rooms, room, [content, bins - used])
    return [(content, bins) for groups in open_bins.values() for content, bins in groups]


def _put(open_bins: dict[int, list[list]], rooms: list[int], room: int, group: list) -> None:
    if not open_bins[room]:
        rooms.insert(bisect_right(rooms, room), room)
    open_bins[room].append(group)


def plan_bins(counts: dict[int, int], capacity: int) -> Bins:
    """Bins as (((length, times), ...), number of such bins)."""
    fixed, left = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(left, capacity)


def _slots(bins: Bins) -> dict[str, np.ndarray]:
    """Where the rank-th piece of a length goes, as runs of ranks."""
    rank: dict[int, int] = defaultdict(int)
    runs, sequence = [], 0
    for content, n in bins:
        offset = 0
        for size, times in content:
            runs.append((size, rank[size], sequence, times, offset))
            rank[size] += n * times
            offset += size * times
        sequence += n
    runs.sort()
    size, first, base, times, offset = np.array(runs, np.int64).reshape(-1, 5).T
    return {"key": (size << 44) + first, "size": size, "first": first, "base": base, "times": times, "offset": offset}


def tokenised_pieces(
    docs: DataFrame, tokenizer: str, pattern: str, id_col: str, text: str, capacity: int, end_id: int, with_ids: bool, whole: str | None
) -> DataFrame:
    """One row per piece, with its rank among the task's pieces of the same length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ids_of(tokenizer, pattern, whole)
        seen = [0] * (capacity + 1)
        part = TaskContext.get().partitionId()
        for batch in batches:
            rows, ids_out = [], []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(value.as_py() or ""), end_id).astype("<u4")
                for k, (start, n) in enumerate(cut(len(ids), capacity)):
                    piece = ids[start : start + n]
                    rows.append((part, key, k, start, n, zlib.crc32(piece.tobytes()), seen[n]))
                    seen[n] += 1
                    if with_ids:
                        ids_out.append(piece.astype(np.int32))
            if rows:
                kinds = (pa.int32(), batch.schema.field(0).type, pa.int32(), *[pa.int64()] * 4)
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                if with_ids:
                    columns.append(pa.array(ids_out, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["part", id_col, "piece", "start", "length", "ids_crc32", "rank", *["ids"] * with_ids]
    kind = dict(docs.dtypes)[id_col]
    schema = f"part int, {id_col} {kind}, piece int, start long, length long, ids_crc32 long, rank long" + ", ids array<int>" * with_ids
    return spread(docs.select(id_col, text)).mapInArrow(run, schema)


def pack(
    docs: DataFrame,
    tokenizer: str,
    pattern: str,
    id_col: str = "doc_id",
    text: str = "text",
    capacity: int = 1024,
    end_id: int = 2,
    with_ids: bool = False,
    whole: str | None = None,
) -> DataFrame:
    """Packs all documents into few sequences of at most ``capacity`` tokens.

    Returns a row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and the
    token ids where ``with_ids``. A document's ids are those of the text (null: none; by
    ``tokenizer``, a file of ranks, or ``whole``, as ``ids_of`` says) and ``end_id``; only longer ones than a sequence are cut.

    Executors tokenise and count. The plan needs no more than the histogram of lengths, at most
    ``capacity`` numbers whatever the size of the corpus, so it is made for the whole corpus at
    once: first Martello-Toth dominance reduction, then best fit for the rest. Pieces find their
    place by their rank among equal lengths: rank in the task plus the count in tasks before.
    Repeated rows and null ids are packed like any other; no documents give no rows. A very long
    text is encoded as a whole within its task, which takes memory in proportion to the text alone.
    """
    spark = docs.sparkSession
    pieces = materialise(
        tokenised_pieces(docs, tokenizer, pattern, id_col, text, capacity, end_id, with_ids, whole), "pieces"
    )
    counts = materialise(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(_slots(plan_bins(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = materialise(
        counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift")), "shifts"
    )

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        s, length, rank = slots.value, length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(s["key"], (length << 44) + rank, "right") - 1
        nth = rank - s["first"][at]
        return pd.DataFrame(
            {
                "sequence_id": s["base"][at] + nth // s["times"][at],
                "offset": s["offset"][at] + nth % s["times"][at] * length,
            }
        )

    # Shifts grow with the tasks, and their file is far smaller than their rows: never broadcast.
    placed = pieces.join(shifts.hint("merge"), ["part", "length"]).withColumn(
        "at", place("length", F.col("rank") + F.col("shift"))
    )
    return placed.select(
        id_col, "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset", *["ids"] * with_ids
    )


def sequences(packed: DataFrame) -> DataFrame:
    """``pack(..., with_ids=True)`` to one row per sequence: sequence_id, ids, n_pieces."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return (
        packed.groupBy("sequence_id")
        .agg(parts.alias("parts"))
        .select("sequence_id", F.flatten("parts.ids").alias("ids"), F.size("parts").alias("n_pieces"))
    )
