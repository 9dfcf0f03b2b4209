"""Full-text retrieval: postings, BM25, conjunctive match, fallback and rank fusion."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.shared import materialise, spread
from lodestone.operators.ranks import numbered, numbered_within


def word_array(text: Column) -> Column:
    """Lower-case runs of word characters, repeats included."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)(\w+)"))


def postings(docs: DataFrame, key: str, text: str, tokens: Column | None = None) -> DataFrame:
    """(key, term, tf, length): an inverted index. Counted within the row, so no shuffle is needed."""
    words = word_array(F.col(text)) if tokens is None else tokens
    with_words = docs.select(key, words.alias("_w"))
    length = F.size("_w")
    grouped = with_words.select(key, length.alias("length"), F.explode("_w").alias("term"))
    return grouped.groupBy(key, "term", "length").agg(F.count("*").alias("tf"))


def looked_up(docs: DataFrame, key: str, text: str, terms: list[str]) -> tuple[DataFrame, int, float]:
    """Postings of ``terms`` alone, with the number of documents and their mean length: what ``bm25`` asks for.

    Texts are read and cut into words once; of a text's words only the wanted ones leave its row.
    """
    words = spread(docs.select(key, text)).select(key, word_array(F.col(text)).alias("_w"))
    wanted = F.filter("_w", lambda w: w.isin(sorted(set(terms))))
    rows = materialise(words.select(key, F.size("_w").alias("length"), wanted.alias("_hits")), "words")
    n, mean = rows.agg(F.count("*"), F.avg("length")).first()
    hits = rows.select(key, "length", F.explode("_hits").alias("term"))
    return hits.groupBy(key, "term", "length").agg(F.count("*").alias("tf")), n, mean or 1.0


def bm25(index: DataFrame, key: str, terms: list[str], documents: int, mean_length: float, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of documents that hold all ``terms``, by BM25 over the whole index.

    ``documents`` and ``mean_length`` describe the corpus of the index, which may be wider than
    what is looked at. Filters on terms come first, so little of the index is shuffled.
    """
    wanted = sorted(set(terms))
    hits = index.where(F.col("term").isin(wanted))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.lit(float(documents)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(mean_length)))
    df = F.broadcast(df) if len(wanted) <= 10_000 else df  # a row per wanted term at most
    scored = hits.join(df, "term").groupBy(key).agg(F.count("*").alias("n"), F.sum(idf * weight).alias("score"))
    return scored.where(F.col("n") == len(wanted)).select(key, "score")


def all_terms(docs: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """Documents that hold every one of a few terms as words."""
    return docs.where(F.forall(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.array_contains(word_array(F.col(text)), t)))


def substring_match(docs: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """Documents that hold every term anywhere, for writing without word gaps."""
    found = F.lit(True)
    for t in terms:
        found = found & F.lower(F.col(text)).contains(t.lower())
    return docs.where(found)


def reciprocal_rank_fusion(streams: DataFrame, key: str = "key", k: int = 60, limit: int | None = None) -> DataFrame:
    """Ranked (stream, rank, key) rows to one ranking: score is the sum of 1 / (k + rank).

    In a stream a key counts by its first rank; ties stay in the order in which streams first
    show the keys. ``limit`` is a top-k report.
    """
    first = streams.groupBy(key, "stream").agg(F.min("rank").alias("rank"))
    fused = first.groupBy(key).agg(
        F.sum(1 / (F.lit(float(k)) + F.col("rank"))).alias("score"),
        F.min(F.struct("stream", "rank")).alias("seen"),
        F.array_sort(F.collect_list(F.struct("stream", "rank"))).alias("matches"),
    )
    order = [F.col("score").desc(), F.col("seen"), F.col(key)]
    if limit:  # the window has few rows then
        found = fused.orderBy(*order).limit(limit).withColumn("position", F.row_number().over(Window.orderBy(*order)))
    else:
        found = numbered(fused, order, "position")
    return found.select(key, "position", "score", "matches")


def recency_order(rows: DataFrame, partition: list[str] | None = None) -> DataFrame:
    """``rows`` with the fallback ``rank``: last observed first, then by id."""
    return numbered_within(rows, partition or [], [F.col("last_observed_at").desc(), "evidence_id"], "rank")


def expected_idf(documents: int, df: int) -> float:
    """The IDF of ``bm25`` for one term, for tests and reports."""
    return math.log((documents - df + 0.5) / (df + 0.5) + 1)
