"""What filters do to each other: every order of a few filters, from one count of failure masks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialise, spread

#: Cells of a page of the sketch, and cells that a text touches.
PAGE_BITS, TOUCHED = 16, 4


def _cells(pages: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """The cells of each text, (texts, TOUCHED): all on the text's page, and different ones."""
    first, step = prints & 0xFFFF, (prints >> 16) & 0xFFFF | 1
    at = (first[:, None] + step[:, None] * np.arange(TOUCHED)) & 0xFFFF
    return (pages.astype(np.int64) << PAGE_BITS)[:, None] | at


def _sketched(flush: int):
    """(page, print) rows to the task's counters, as sparse pages: cells met once, and more often."""

    def pages_of(pages: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        cells, n = np.unique(_cells(pages, prints), return_counts=True)
        page, at = cells >> PAGE_BITS, (cells & 0xFFFF).astype("<u2")
        starts = np.flatnonzero(np.append(True, page[1:] != page[:-1]))
        ends = np.append(starts[1:], len(page))
        once = [at[a:b][n[a:b] == 1].tobytes() for a, b in zip(starts, ends, strict=True)]
        more = [at[a:b][n[a:b] > 1].tobytes() for a, b in zip(starts, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(page[starts]), pa.array(once, pa.binary()), pa.array(more, pa.binary())], ["page", "once", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(x) for x, _ in held) >= flush:
                yield pages_of(*map(np.concatenate, zip(*held, strict=True)))
                held = []
        if sum(len(x) for x, _ in held):
            yield pages_of(*map(np.concatenate, zip(*held, strict=True)))

    return run


def _merged(pages: pa.Table) -> pa.Table:
    """All tasks' counters of a page to a bitmap of the cells that were met twice or more."""
    at = lambda name: np.frombuffer(b"".join(pages.column(name).to_pylist()), "<u2")
    again = np.bincount(at("once"), minlength=1 << PAGE_BITS) > 1
    again[at("more")] = True
    return pa.table({"page": pages.column("page")[:1], "again": pa.array([np.packbits(again).tobytes()], pa.binary())})


def possible_repeats(rows: DataFrame, print_: str, cells_per_text: int = 16, most_cells: int = 1 << 28, flush: int = 1 << 20) -> DataFrame:
    """``rows`` with ``possible``: false only for rows whose 64-bit print no other row has.

    A counting Bloom filter in pages: tasks count cells, Spark merges the pages, and what comes
    back is a bit for each cell, set if it was met twice or more. A text of which one cell was met
    once is unique. The filter has ``cells_per_text`` cells for each row and at most
    ``most_cells``, so the merged bits, which every task gets, are at most ``most_cells / 8`` bytes
    (32 MB). With many more rows than cells fewer are cleared; no repeat is ever missed.
    ``rows`` is read twice and should be a written table.
    """
    pages = -(-min(most_cells, max(1, rows.count()) * cells_per_text) >> PAGE_BITS) or 1
    page = F.pmod(F.xxhash64(print_), F.lit(pages)).alias("page")
    tasks = rows.select(page, F.col(print_)).mapInArrow(_sketched(flush), "page long, once binary, more binary")
    merged = tasks.groupBy("page").applyInArrow(_merged, "page long, again binary")
    bits = np.zeros((pages, (1 << PAGE_BITS) // 8), np.uint8)
    for r in merged.toLocalIterator():
        bits[r.page] = np.frombuffer(bytes(r.again), np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = shared.value.reshape(-1)
        for batch in batches:
            at = _cells(batch.column(batch.num_columns - 1).to_numpy(), batch.column(prints).to_numpy())
            found = (flat[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)], names=names)

    prints, names = rows.columns.index(print_), [*rows.columns, "possible"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.select("*", page).mapInArrow(run, f"{kinds}, possible boolean")


def masked(
    docs: DataFrame,
    filters: dict[str, Column],
    repeats: str | None,
    key: str = "doc_id",
    text: str = "text",
    part: str = "lang",
    **sketch: int,
) -> DataFrame:
    """(doc_id, part, mask): of each document the filters that it fails, the first filter as bit 0.

    ``filters``: what failing means, by letter, as conditions on the row. ``repeats`` is the
    letter of one more filter, the last, which fails a document whose text is that of a lesser
    key anywhere in the table. Only texts that the sketch doesn't clear are shuffled for that,
    by SHA-256 and length, which stand for the whole text; the text itself never leaves its task.

    A null text is empty, a null part the empty string, and a condition that is null isn't failed.
    A null key is no lesser key and has none, so such rows don't fail ``repeats``; nor do rows
    that repeat a key with its text, of which none is the lesser.
    """
    t = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    mask = sum((F.coalesce(c, F.lit(False)).cast("int") * (1 << k) for k, c in enumerate(filters.values())), F.lit(0))
    columns = [F.col(key).alias("doc_id"), F.coalesce(part, F.lit("")).alias("part"), mask.alias("mask")]
    if repeats is None:
        return spread(docs).select(*columns)
    digest = F.concat(F.unhex(F.sha2(t, 256)), F.unhex(F.lpad(F.hex(F.octet_length(t)), 8, "0")))
    rows = materialise(spread(docs).select(*columns, F.xxhash64(t).alias("print"), digest.alias("digest")), "masked")
    flagged = materialise(possible_repeats(rows, "print", **sketch).drop("print"), "flagged")
    own = flagged.where("possible")
    least = own.groupBy(F.col("digest").alias("of")).agg(F.min("doc_id").alias("least"))
    # Written before it is joined: a plain join, of which adaptive execution splits a hot text.
    least = materialise(least, "least")
    late = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).cast("int") * (1 << len(filters))
    looked = own.join(least, own.digest == least.of).select("doc_id", "part", (F.col("mask") + late).alias("mask"))
    return flagged.where("not possible").select("doc_id", "part", "mask").union(looked)


def counted(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by what they fail, and those that labels call good or toxic.

    A document is good (toxic) if any row of ``labels`` for its key has quality (toxic) 1; null keys
    have no labels.
    """
    known = labels.where("quality = 1 or toxic = 1").groupBy(F.col("doc_id").alias("of"))
    known = materialise(known.agg(F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic")), "labelled")
    found = masks.join(known, masks.doc_id == known.of, "left").groupBy("part", "mask")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return found.agg(F.count("*").alias("n"), total("good"), total("toxic"))


def orders(counts: DataFrame, letters: str) -> DataFrame:
    """Every order of the filters ``letters`` applied to ``counts``, a row for each part, order and step.

    kept and removed follow from the masks: a step removes what fails its filter and none of the
    filters before. Of n filters, the first-failing shares of a document that fails k of them are
    n!/k orders for each, which is what ``shapley`` adds up. At most eight filters, as rows grow
    with their factorial.
    """
    if len(letters) > 8:
        raise ValueError("over eight filters")
    entry = F.struct("mask", "n", "good", "toxic")
    rows = counts.groupBy("part").agg(F.collect_list(entry).alias("masks"))  # at most 2 ** filters each
    rows = rows.select("part", "masks", F.lit("").alias("filter_order"), F.lit(0).alias("before"), F.array().cast("array<struct<step:int,letter:string,bit:int,before:int>>").alias("steps"))
    for k in range(len(letters)):
        left = F.array_compact(F.array(*[F.when(F.instr("filter_order", x) == 0, F.struct(F.lit(k + 1).alias("step"), F.lit(x).alias("letter"), F.lit(1 << i).alias("bit"), F.col("before").alias("before"))) for i, x in enumerate(letters)]))
        rows = rows.withColumn("next", F.explode(left)).select("part", "masks", F.concat("filter_order", "next.letter").alias("filter_order"), (F.col("before") + F.col("next.bit")).alias("before"), F.array_append("steps", F.col("next")).alias("steps"))
    rows = rows.withColumn("s", F.explode("steps"))
    bit, before = F.col("s.bit"), F.col("s.before")
    all_orders = F.lit(int(np.prod(range(1, len(letters) + 1))))

    def total(field: str, chosen) -> Column:
        hit = F.filter("masks", chosen)
        return F.aggregate(hit, F.lit(0).cast("long"), lambda s, x: s + x[field])

    fails = lambda x: x["mask"].bitwiseAND(bit) != 0
    late = lambda x: x["mask"].bitwiseAND(before) != 0
    gone = lambda x: fails(x) & ~late(x)
    share = F.aggregate(F.filter("masks", fails), F.lit(0).cast("long"), lambda s, x: s + x["n"] * F.call_function("div", all_orders, F.bit_count(x["mask"])))
    return rows.select(
        "part",
        "filter_order",
        F.col("s.step").alias("step"),
        total("n", lambda x: x["mask"].bitwiseAND(before + bit) == 0).alias("kept"),
        total("n", gone).alias("removed"),
        total("n", lambda x: fails(x) & late(x)).alias("redundant"),
        total("n", lambda x: x["mask"] == bit).alias("unique_fails"),
        total("good", gone).alias("good_lost"),
        total("toxic", gone).alias("toxic_lost"),
        share.alias("shapley"),
    )


def audited(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], repeats: str | None = None, **how) -> DataFrame:
    """What each filter removes in each order, by part. Empty documents give an empty table."""
    letters = "".join(filters) + (repeats or "")
    return orders(counted(masked(docs, filters, repeats, **how), labels), letters)
