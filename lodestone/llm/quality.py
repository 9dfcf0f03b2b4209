"""Quality rules: per-document counts and cross-document line frequency, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import SPACE, materialise, spread, words

#: Characters that count as symbols (fixed value).
SYMBOLS = "#*$%&|<>"


def normalised_line(line: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.lower(F.array_join(words(line), " "))


def lines(text: Column) -> Column:
    """The \\n-split lines that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def measured(docs: DataFrame, keep: list[str], text: str = "text", host: str = "source") -> DataFrame:
    """Counts of each row of ``docs``, written to the shared folder.

    One pass over the texts; each document's work stays in its own row, and sorts rather than
    compares its windows, so a very long text takes n log n. Returns ``doc`` (a struct of the
    columns ``keep``, so that no name can clash), ``row`` (unique), ``host``, ``content`` (hash
    of the text), ``lines`` (hash and words of each) and the counts. A null text is empty.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    base = spread(docs).select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"),
        F.col(host).alias("host"),
        F.monotonically_increasing_id().alias("row"),
        t.alias("_t"),
        words(t).alias("_w"),
        lines(t).alias("_l"),
    )
    n = F.size("_w")
    # Windows of three words, by the hashes of their words; get() past the end is never asked for.
    windows = F.transform(
        F.slice("_v", 1, F.greatest(n - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get("_v", i + 1), F.get("_v", i + 2)),
    )
    step = base.withColumn("_v", F.transform("_w", lambda w: F.xxhash64(w))).withColumn("_h", windows)
    ordered = F.when(
        F.size(F.array_distinct("_h")) < F.size("_h"),
        F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    step = step.withColumn("_s", ordered)
    twice = F.transform(
        "_s",
        lambda x, i: F.when(
            F.coalesce(F.get("_s", i + 1)["h"] == x["h"], F.lit(False))
            | ((i > 0) & F.coalesce(F.get("_s", F.greatest(i - 1, F.lit(0)))["h"] == x["h"], F.lit(False))),
            x["i"],
        ),
    )
    step = step.withColumn("_p", F.sort_array(F.array_compact(twice)))
    covered = F.aggregate(
        F.transform("_p", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("_p", i + 1) - x, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    by_line = F.transform(
        F.transform("_l", words),
        lambda w: F.struct(F.xxhash64(F.lower(F.array_join(w, " "))).alias("line"), F.size(w).alias("n")),
    )
    found = step.select(
        "doc",
        "row",
        "host",
        F.xxhash64("_t").alias("content"),
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", SPACE + "+", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).alias("n_repeat_words"),
        by_line.alias("lines"),
    )
    return materialise(found, "measured")


def frequent_lines(rows: DataFrame, least: int, share: float) -> DataFrame:
    """(host, line) of lines in over ``least`` documents and over ``share`` of a host's.

    Documents with the same text count once, so copies don't make a clean text's lines frequent.
    A ``share`` of 0 leaves the count alone, which doesn't grow with the host.
    """
    own = rows.select("host", "content", F.explode("lines.line").alias("line"))
    per_line = own.distinct().groupBy("host", "line").agg(F.count("*").alias("n"))
    per_host = rows.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    # A row per host, written: a host with a third of all lines is then a plain join's hot key.
    per_host = materialise(per_host.withColumnRenamed("host", "of"), "hosts")
    per_line = per_line.where(F.col("n") > least)
    return (
        per_line.join(per_host, per_line.host.eqNullSafe(per_host.of))
        .where(F.col("n") > share * F.col("docs"))
        .select("host", "line")
    )


def judged(rows: DataFrame, least: int = 10, share: float = 0.2, depleted: float = 0.5, min_words: int = 50) -> DataFrame:
    """``measured`` rows with base_failed, kept, n_removed (words) and removed (line hashes).

    A document fails the base rules with under ``min_words`` words, or with over half of its
    words in repeated three-word windows. Of one that passes, frequent lines are removed, and
    it is kept unless over ``depleted`` of its words go with them.
    """
    common = materialise(frequent_lines(rows, least, share), "frequent")
    c = common.select(F.col("host").alias("of"), F.col("line").alias("common"))
    each = rows.select("row", "host", F.explode("lines").alias("x")).select("row", "host", "x.line", "x.n")
    gone = (
        each.join(c, (each.line == c.common) & each.host.eqNullSafe(c.of))
        .groupBy("row")
        .agg(F.sum("n").alias("n_removed"), F.collect_set("line").alias("removed"))
        .withColumnRenamed("row", "_row")
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    lost = F.coalesce("n_removed", F.lit(0))
    return (
        rows.join(gone, rows.row == gone._row, "left")
        .withColumn("n_removed", lost)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (lost <= depleted * F.col("n_words")))
        .drop("_row")
    )


def filtered(docs: DataFrame, text: str = "text", host: str = "source", **limits) -> DataFrame:
    """The documents that the rules keep, without the lines that are too frequent on their host.

    Returns the columns of ``docs``. Repeated rows are judged alike; null hosts are one host.
    """
    rows = measured(docs, docs.columns, text, host)
    good = judged(rows, **limits).where("kept")
    whole = F.col("doc").getField(text)
    left = F.filter(
        F.split(whole, "\n"),
        lambda x: ~F.array_contains("removed", F.xxhash64(normalised_line(x))),
    )
    cleaned = F.when(F.col("removed").isNull(), whole).otherwise(F.array_join(left, "\n"))
    return good.select(
        *[(cleaned if c == text else F.col("doc").getField(c)).alias(c) for c in docs.columns]
    )
