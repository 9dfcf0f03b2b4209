"""Greedy choice in order under a budget, mostly in parallel."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.shared import materialise
from lodestone.operators.ranks import Order, running


#: Undecided rows that are few enough to be folded at once.
FEW = 10_000


def greedy(rows: DataFrame, group: list[str], order: Order, size: Column, limit, most: int | None = None, out: str = "fits", rounds: int = 8) -> DataFrame:
    """``rows`` with ``out``: whether each found room in its group when its turn came.

    In order, a row is taken if it fits what is left of ``limit`` and fewer than ``most`` are
    taken; what is passed over takes no room, so later and smaller rows may still fit. Sizes are
    not negative; null sizes fit nowhere. End ``order`` with a key.

    While over ``FEW`` rows are undecided, two cuts are made by many tasks, at most ``rounds``
    times: rows larger than what is left go, and rows whose running sum over all that are left
    fits are taken. What is undecided then, behind the first row that was passed over and small
    enough for the rest of the room, is folded in order, a group in one task as a stream, with
    two numbers carried.
    """
    columns, no = rows.columns, F.lit(False)
    below = F.lit(True) if most is None else F.col("_n") < most
    room = F.coalesce((F.col("_size") <= F.lit(limit) - F.col("_used")) & below, no)
    left = rows.withColumns({"_size": size, "_used": F.lit(0).cast("decimal(25,12)"), "_n": F.lit(0).cast("long")})
    parts = []
    for k in range(rounds + 1):
        parts.append(left.where(~room).select(*columns, no.alias(out)))
        undecided = materialise(left.where(room), "undecided")
        n = undecided.count()
        if n <= FEW or k == rounds:
            parts.append(_folded(undecided, columns, group, order, limit, most, out))
            return reduce(DataFrame.unionByName, parts)
        found = running(undecided, group, order, {"_sum": F.col("_size"), "_nth": F.lit(1).cast("long")})
        fits = F.col("_sum").cast("decimal(36,12)") + F.col("_used") <= F.lit(limit)
        fits = fits if most is None else fits & (F.col("_n") + F.col("_nth") <= most)
        found = materialise(found.withColumn(out, fits), "greedy")
        parts.append(found.where(out).select(*columns, out))
        taken = found.where(out).groupBy(*[F.col(g).alias(f"_of{i}") for i, g in enumerate(group)]).agg(F.sum("_size").cast("decimal(25,12)").alias("_more"), F.count("*").alias("_and"))
        taken = materialise(taken, "taken")
        same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_of{i}")) for i, g in enumerate(group)], F.lit(True))
        left = found.where(~F.col(out)).join(taken, same, "left").withColumns({
            "_used": (F.col("_used") + F.coalesce("_more", F.lit(0))).cast("decimal(25,12)"), "_n": F.col("_n") + F.coalesce("_and", F.lit(0))
        }).select(*columns, "_size", "_used", "_n")


def _folded(left: DataFrame, columns: list[str], group: list[str], order: Order, limit, most: int | None, out: str) -> DataFrame:
    """Undecided rows, a group at a time in order."""
    left = left.withColumn("_group", F.to_json(F.struct(*group)) if group else F.lit(""))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used, n = object(), 0, 0
        for frame in batches:
            taken = []
            for key, x, before, count in zip(frame["_group"], frame["_size"], frame["_used"], frame["_n"], strict=True):
                if key != now:
                    now, used, n = key, before, count
                fits = used + x <= limit and (most is None or n < most)
                used, n = (used + x, n + 1) if fits else (used, n)
                taken.append(bool(fits))
            yield frame[columns].assign(**{out: taken})

    schema = left.select(*columns, F.lit(True).alias(out)).schema
    return left.repartition("_group").sortWithinPartitions("_group", *order).mapInPandas(run, schema)
