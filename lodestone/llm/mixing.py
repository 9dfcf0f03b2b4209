"""Mixing sources to target weights by repetition rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialise, spread, words
from lodestone.operators.ranks import numbered, numbered_within


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), limit: float = 3.0) -> DataFrame:
    """``(source, source_size)`` to ``(source, source_size, target)``.

    Sources in code-point order, null last, take ``weights`` in turn and share the total size.
    A target stops at ``limit`` times its source's size; the excess goes to the others by
    weight until none is above. Only sums and the counts of ranges come to the driver; sources
    stay a table, ranked by many tasks.
    """
    turn = F.array(*[F.lit(float(w)) for w in weights])
    sizes = materialise(sizes, "sizes")  # the ranges are sampled first
    nth = numbered(sizes, [F.col("source").asc_nulls_last()], "nth")
    table = materialise(nth.withColumn("weight", F.get(turn, (F.col("nth") - 1) % len(weights))).drop("nth"), "sources")
    top = F.col("source_size") * F.lit(float(limit))
    total = float(table.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        over = top <= F.col("weight") * F.lit(level)
        n, held, free = table.agg(
            F.count_if(over), F.sum(F.when(over, top).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))
        ).first()
        if n == capped or not free:
            break
        level, capped = (total - held) / free, n
    return table.select(
        "source", "source_size", F.least(top, F.col("weight") * F.lit(level)).alias("target")
    )


def uniform(key: Column, seed: int, nth: Column | None = None) -> Column:
    """A number in [0, 1) that depends on seed, key and (from the second row of a key on) ``nth`` alone."""
    parts = [F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit(""))]
    if nth is not None:
        parts.append(F.when(nth > 1, nth.cast("string")))  # concat_ws leaves nulls out
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def _sized(docs: DataFrame, id_col: str, text: str, source: str) -> list[Column]:
    return [
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{source}`").alias("source"), F.size(words(F.col(f"`{text}`"))).cast("long").alias("size"),
        F.xxhash64(F.col(f"`{text}`")).alias("hash"), F.monotonically_increasing_id().alias("row"),
    ]


def _repeats(sized: DataFrame) -> DataFrame:
    """``again``: the ids, null among them, of more than one row."""
    many = sized.groupBy("id").count().where(F.col("count") > 1)
    return materialise(many.select(F.col("id").alias("again")), "repeats")


#: What numbers the rows of an id: rows alike in all but the last are interchangeable.
ORDER = ["source", "size", "hash", "row"]


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    limit: float = 3.0,
    seed: int = 20,
) -> DataFrame:
    """How often the mix takes each document: id, source, size, source_size, target, copies.

    Size is the number of words (null text: 0). Each document of a source is taken
    floor(rate) times, rate = target / source_size, and once more with the fraction's
    probability, drawn from a hash of seed and id, so reruns agree and no shuffle of texts is
    needed. A source without words has rate 0. Rows of one id, null ids among them, are numbered
    by source, size and text, and each but the first draws by its number too, so that an id with
    many rows comes near its share. Only ids and sizes are shuffled; sources combine before.
    """
    sized = materialise(spread(docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys((id_col, text, source))))).select(*_sized(docs, id_col, text, source)), "sizes")
    goals = materialise(
        targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, limit), "targets"
    )
    g = goals.withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    again = _repeats(sized)
    if again.isEmpty():
        drawn = sized.withColumn("nth", F.lit(1).cast("long"))
    else:
        same = F.col("id").eqNullSafe(F.col("again"))
        once = sized.join(again, same, "left_anti").withColumn("nth", F.lit(1).cast("long"))
        drawn = once.unionByName(numbered_within(sized.join(again, same, "left_semi"), ["id"], ORDER, "nth"))
    return drawn.join(g, drawn.source.eqNullSafe(g.of)).select(
        F.col("id").alias(id_col),
        F.col("source").alias(source),
        "size",
        "source_size",
        "target",
        (whole + (uniform(F.col("id"), seed, F.col("nth")) < rate - whole).cast("long")).alias("copies"),
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    limit: float = 3.0,
    seed: int = 20,
) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as ``mixed`` takes it."""
    # The document in one column, so that no name can clash.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    sized = materialise(docs.select(*_sized(docs, id_col, text, source)), "sizes")
    goals = materialise(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, limit), "targets")
    g = goals.select(
        F.col("source").alias("of"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
    )
    again = _repeats(sized)
    rows = docs.select(whole, *_sized(docs, id_col, text, source))
    if again.isEmpty():
        rows = rows.select("doc", "id", "source", F.lit(1).cast("long").alias("nth"))
    else:
        same = F.col("id").eqNullSafe(F.col("again"))
        once = rows.join(again, same, "left_anti").select("doc", "id", "source", F.lit(1).cast("long").alias("nth"))
        more = materialise(rows.join(again, same, "left_semi"), "repeated")
        nth = numbered_within(more.drop("doc"), ["id"], ORDER, "nth").select(F.col("row").alias("of_row"), "nth")
        rows = once.union(more.join(nth, F.col("row") == F.col("of_row")).select("doc", "id", "source", "nth"))
    floor = F.floor("rate")
    times = floor + (uniform(F.col("id"), seed, F.col("nth")) < F.col("rate") - floor).cast("long")
    return (
        rows.join(g, rows.source.eqNullSafe(g.of))
        .select("doc", times.alias("times"))
        .where("times > 0")
        .select("doc", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
        .select("doc.*")
    )
