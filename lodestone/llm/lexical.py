"""Ranked lexical search: posting lists in geometric blocks, skipped by exact bounds of their summaries."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lodestone.llm.common import materialise, spread

#: Bytes that stand in terms: digits, letters (A-Z as a-z) and all of other than ASCII (fixed values).
IN_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Dimensions in which documents are compared when lists are cut into blocks.
DIMENSIONS = 24


def terms(text: bytes | None) -> list[bytes]:
    """The maximal runs of term characters of a text in UTF-8, repeats included."""
    return (text or b"").translate(IN_TERMS).split()


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What each posting counts for before its term's weight: whole numbers below 10**6."""
    m = 10 + (90 * n * documents) // max(total, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _forward(shared):
    """(key, text) to the key, the number of terms, and which of the wanted terms how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            sizes, at, tf = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                found = terms(text.as_py())
                hits = [(wanted[t], n) for t, n in Counter(found).items() if t in wanted]
                sizes.append(len(found))
                at.append(np.array([x for x, _ in hits], "<i4").tobytes())
                tf.append(np.array([n for _, n in hits], "<i4").tobytes())
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(at, pa.binary()), pa.array(tf, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "terms", "tfs"])

    return run


def _frequencies(width: int):
    """In how many of a task's documents each term is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(width, np.int64)
        for batch in batches:
            for x in batch.column(0):
                df[np.frombuffer(x.as_py(), "<i4")] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["term", "df"])

    return run


def _flat(starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the entries of ``rows`` of a ragged array, and where each row begins among them."""
    n = starts[rows + 1] - starts[rows]
    first = np.cumsum(n) - n
    return np.repeat(starts[rows] - first, n) + np.arange(n.sum()), first


@dataclass
class Shard:
    """The index of some documents. Ragged arrays have a ``_starts``; impacts are whole numbers.

    ``lists`` are terms in the order of their blocks; the last is -1, a list of all documents,
    which the terms of ``common`` share. ``largest`` is each term's greatest impact.
    """

    keys: np.ndarray
    known: np.ndarray
    terms: np.ndarray
    impacts: np.ndarray
    terms_starts: np.ndarray
    common: np.ndarray
    lists: np.ndarray
    lists_starts: np.ndarray
    members: np.ndarray
    members_starts: np.ndarray
    summary_terms: np.ndarray
    summary_maxima: np.ndarray
    summary_starts: np.ndarray


def _clusters(members: np.ndarray, shape: np.ndarray, block: int, rng: np.random.Generator) -> list[np.ndarray]:
    """A list's documents by the most similar of some pivots among them."""
    if len(members) <= block:
        return [members]
    pivots = shape[rng.choice(members, -(-len(members) // block), replace=False)]
    nearest = np.concatenate([(shape[members[k : k + 4096]] @ pivots.T).argmax(axis=1) for k in range(0, len(members), 4096)])
    order = np.argsort(nearest, kind="stable")
    cuts = np.flatnonzero(np.diff(nearest[order])) + 1
    return np.split(members[order], cuts)


def built(keys: np.ndarray, known: np.ndarray, starts: np.ndarray, at: np.ndarray, x: np.ndarray, width: int, block: int, share: float) -> Shard:
    """The shard of documents with entries (term ``at``, impact ``x``) in ragged rows."""
    rng = np.random.default_rng(0)
    docs = len(keys)
    axes = rng.choice(np.array([-1, 1], np.float32), (width, DIMENSIONS))
    shape = np.zeros((docs, DIMENSIONS), np.float32)
    for k in range(0, docs, 1024):
        a, b = starts[k], starts[min(k + 1024, docs)]
        shape[k : k + 1024] = np.add.reduceat(axes[at[a:b]] * x[a:b, None].astype(np.float32), starts[k : min(k + 1024, docs)] - a)
    x = x.astype(np.int32)
    shape /= np.maximum(np.linalg.norm(shape, axis=1, keepdims=True), 1e-9)
    df = np.bincount(at, minlength=width)
    common = np.flatnonzero(df > max(block, share * docs))
    owner = np.repeat(np.arange(docs), np.diff(starts))
    order = np.argsort(at, kind="stable")
    ends = np.cumsum(df)
    own = np.setdiff1d(np.flatnonzero(df), common)
    blocks, lists_starts = [], [0]
    for members in [*(owner[order[ends[t] - df[t] : ends[t]]] for t in own), np.arange(docs)]:
        blocks += _clusters(members, shape, block, rng)
        lists_starts.append(len(blocks))
    members_starts = np.cumsum([0, *map(len, blocks)])
    members = np.concatenate(blocks)
    # Coordinatewise maxima, some blocks at a time, so that little is laid out at once.
    summaries, most = [], max(1, (1 << 20) // width)
    for k in range(0, len(blocks), most):
        own_starts = members_starts[k : k + most + 1]
        rows = members[own_starts[0] : own_starts[-1]]
        spots, _ = _flat(starts, rows)
        block_of = np.repeat(np.repeat(np.arange(len(own_starts) - 1), np.diff(own_starts)), starts[rows + 1] - starts[rows])
        maxima = np.zeros((len(own_starts) - 1, width), np.int32)
        np.maximum.at(maxima.reshape(-1), block_of * width + at[spots], x[spots])
        row, column = maxima.nonzero()
        summaries.append((column.astype(np.int32), maxima[row, column], np.bincount(row, minlength=len(maxima))))
    sizes = np.concatenate([s for _, _, s in summaries])
    return Shard(
        keys, known, at, x, starts, common, np.append(own, -1), np.array(lists_starts), members, members_starts,
        np.concatenate([t for t, _, _ in summaries]), np.concatenate([m for _, m, _ in summaries]), np.append(0, np.cumsum(sizes)),
    )


@dataclass
class Queries:
    """Terms and weights of each query, as arrays, and a score that its k-th best reaches anyway."""

    terms: list[np.ndarray]
    weights: list[np.ndarray]
    least: np.ndarray


def searched(shard: Shard, queries: Queries, width: int, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, documents, scores): the k best of a shard, or those that can be among the k best of all.

    A document whose terms' lists can't add up to the score to beat is never met, and of the
    lists that are opened only blocks whose bound reaches it. Both bounds are sums of maxima
    over what they cover, so nothing that ranks is lost; equal scores are kept for their ids.
    """
    largest = np.zeros(width, np.int64)
    np.maximum.at(largest, shard.terms, shard.impacts)
    common = np.zeros(width, bool)
    common[shard.common] = True
    place = {int(t): i for i, t in enumerate(shard.lists)}
    q, seen = np.zeros(width, np.int64), np.zeros(len(shard.keys), bool)
    for number, (own, weights) in enumerate(zip(queries.terms, queries.weights, strict=True)):
        most = weights * largest[own]
        order = np.argsort(most, kind="stable")
        reach = np.cumsum(most[order])
        beat = max(1, int(queries.least[number]))
        if not len(own) or reach[-1] < beat:
            continue
        q[own] = weights
        seen[:] = False
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for i in range(len(order) - 1, -1, -1):
            if reach[i] < beat:
                break  # what only this and lesser terms have in common with the query doesn't rank
            everywhere = bool(common[own[order[i]]])
            at = place.get(-1 if everywhere else int(own[order[i]]))
            if at is None:
                continue
            blocks = np.arange(shard.lists_starts[at], shard.lists_starts[at + 1])
            spots, first = _flat(shard.summary_starts, blocks)
            bounds = np.add.reduceat(q[shard.summary_terms[spots]] * shard.summary_maxima[spots], first)
            spots, _ = _flat(shard.members_starts, blocks[bounds >= beat])
            new = shard.members[spots]
            new = new[~seen[new]]
            if len(new):
                seen[new] = True
                spots, first = _flat(shard.terms_starts, new)
                got = np.add.reduceat(q[shard.terms[spots]] * shard.impacts[spots], first)
                good = got >= beat
                docs, scores = np.append(docs, new[good]), np.append(scores, got[good])
                best = np.lexsort((shard.keys[docs], ~shard.known[docs], -scores))[:k]
                docs, scores = docs[best], scores[best]
                if len(docs) == k:
                    beat = max(beat, int(scores[-1]))
            if everywhere:
                break  # that list had all documents
        q[own] = 0
        if len(docs):
            yield number, docs, scores


def _ranked(shared, width: int, documents: int, total: int, shard_docs: int, block: int, share: float, k: int):
    """Documents of ``_forward``, as shards of at most ``shard_docs``, to the best of each for each query."""

    def shard_of(held: list[pa.RecordBatch]) -> Shard:
        rows = pa.Table.from_batches(held)
        at = [np.frombuffer(v, "<i4") for v in rows.column("terms").to_pylist()]
        tf = np.concatenate([np.frombuffer(v, "<i4") for v in rows.column("tfs").to_pylist()]).astype(np.int64)
        sizes = np.array([len(v) for v in at])
        n = np.repeat(rows.column("n").to_numpy(), sizes)
        keys = rows.column("key")
        return built(
            keys.fill_null(0).to_numpy(), keys.is_valid().to_numpy(), np.append(0, np.cumsum(sizes)),
            np.concatenate(at).astype(np.int64), impacts(tf, n, documents, total), width, block, share,
        )

    def answers(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = shard_of(held)
        for number, docs, scores in searched(shard, shared.value, width, k):
            keys = pa.array(shard.keys[docs], mask=~shard.known[docs])
            columns = [pa.array(np.full(len(docs), number, np.int32)), keys, pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, names=["query", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        room = shard_docs
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, room))
                batch, room = batch.slice(room), room - held[-1].num_rows
                if not room:
                    yield from answers(held)
                    held, room = [], shard_docs
        if held:
            yield from answers(held)

    return run


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def forward(docs: DataFrame, wanted: list[bytes], key: str, text: str) -> tuple[DataFrame, int, int, list[int]]:
    """What each document of any term has of the ``wanted`` ones, written; documents, all their terms, and weights."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(wanted)})
    rows = spread(docs).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    rows = materialise(rows.mapInArrow(_forward(shared), "key long, n long, terms binary, tfs binary"), "forward").where("n > 0")
    documents, total = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    counts = rows.select("terms").mapInArrow(_frequencies(len(wanted)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    df = dict.fromkeys(range(len(wanted)), 0) | {r.term: r.df for r in counts.collect()}  # a row per wanted term at most
    return rows.where(F.octet_length("terms") > 0), documents, total, [weight(documents, df[i]) for i in range(len(wanted))]


def search(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    k: int = 10,
    shard_docs: int = 4096,
    block: int = 32,
    share: float = 1 / 32,
    at_once: int = 10_000,
) -> DataFrame:
    """(item, rank, doc_id, score): the ``k`` highest-scoring documents of each row of ``items``.

    Tasks index the documents they read as shards of at most ``shard_docs``, so no posting list
    is shuffled and a term in every document loads no task more than another. In a shard each
    term's list is clustered around pivots by similarity into blocks of about ``block``, which
    hold the coordinatewise maximum of their documents; terms in over ``share`` of a shard's
    documents share one such list, of all of them. A shard is searched where it was made, as
    its blocks take more room than its documents. A sixteenth of the documents goes first: what
    the k-th best of them scores has to be beaten by the others. Results are exact.

    Only terms of the queries are indexed, as others add nothing; queries come ``at_once``
    at a time, each lot with an index of its own. Null texts and items have no terms; items with
    no hit have no rows; rows that repeat an item are queries of their own; null keys rank last
    among equals. Keys are longs. A long text is counted within its task.
    """
    spark, found, lot = docs.sparkSession, None, []
    schema = StructType([StructField("query", IntegerType()), items.select(item).schema[0], *StructType.fromDDL("rank int, doc_id long, score long").fields])

    def answered(lot: list[tuple]) -> DataFrame:
        asked = [sorted(set(terms((t or "").encode()))) for _, t in lot]
        wanted = sorted({t for a in asked for t in a})
        rows, documents, total, weights = forward(docs, wanted, key, text)
        place = {t: i for i, t in enumerate(wanted)}
        at = [np.array([place[t] for t in a], np.int64) for a in asked]
        w = [np.array(weights, np.int64)[x] for x in at]
        least = np.zeros(len(lot), np.int64)

        def ranked(part: DataFrame) -> DataFrame:
            shared = spark.sparkContext.broadcast(Queries(at, w, least.copy()))
            return part.mapInArrow(_ranked(shared, len(wanted), documents, total, shard_docs, block, share, k), "query int, doc_id long, score long")

        first = F.pmod(F.xxhash64("key", "terms"), F.lit(16)) == 0
        sample = materialise(_best(ranked(rows.where(first)), k), "first")
        for r in sample.where(F.col("rank") == k).collect():  # a number per query at most
            least[r["query"]] = r.score
        best = _best(sample.drop("rank").union(ranked(rows.where(~first))), k)
        names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(lot)], StructType(schema.fields[:2]))
        return best.join(F.broadcast(names), "query").select(item, "rank", "doc_id", "score")

    for r in items.select(item, item_text).toLocalIterator():
        lot.append((r[0], r[1]))
        if len(lot) == at_once:
            found, lot = answered(lot) if found is None else found.union(answered(lot)), []
    if lot:
        found = answered(lot) if found is None else found.union(answered(lot))
    return spark.createDataFrame([], StructType(schema.fields[1:])) if found is None else found
