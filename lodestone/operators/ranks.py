"""Row numbers over whole tables and hot groups, made by many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from lodestone.functions.shared import materialise

Order = list[Column | str]


def numbered(rows: DataFrame, order: Order, out: str) -> DataFrame:
    """``rows`` with their number by ``order``, a long from 1.

    A window over all rows would be one task. Here rows are dealt by range, each range is
    numbered by itself, and the counts of the ranges before are added; the driver gets one count
    of each range. Rows are written in between, so that ranges stay as they are if a task runs
    again. Ties are numbered in any order: end ``order`` with a key. Nulls sort as ``order`` says.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = rows.repartitionByRange(n, *by).withColumn("_range", F.spark_partition_id())
    ranged = materialise(ranged, "ranges")
    before, total = [], 0
    for r in ranged.groupBy("_range").count().orderBy("_range").collect():
        before += [total] * (r["_range"] + 1 - len(before))
        total += r["count"]
    shift = F.get(F.array(*[F.lit(k).cast("long") for k in before or [0]]), F.col("_range"))
    return ranged.withColumn(out, shift + F.row_number().over(Window.partitionBy("_range").orderBy(*by))).drop("_range")


def numbered_within(rows: DataFrame, group: list[str], order: Order, out: str) -> DataFrame:
    """``rows`` with their number by ``order`` within their group, a long from 1.

    A group may hold most of the rows: all are numbered at once by group and order, and the
    number of a group's first is taken off. Rows of null groups are a group.
    """
    if not group:
        return numbered(rows, order, out)
    found = numbered(rows, [*group, *order], out)
    first = found.groupBy(*[F.col(g).alias(f"_of{k}") for k, g in enumerate(group)]).agg((F.min(out) - 1).alias("_before"))
    first = materialise(first, "groups")  # a plain join then, of which Spark splits the hot side
    same = F.lit(True)
    for k, g in enumerate(group):
        same = same & found[g].eqNullSafe(first[f"_of{k}"])
    return found.join(first, same).withColumn(out, F.col(out) - F.col("_before")).drop("_before", *[f"_of{k}" for k in range(len(group))])


def running(rows: DataFrame, group: list[str], order: Order, sums: dict[str, Column]) -> DataFrame:
    """``rows`` with running sums within their group by ``order``, the row's own value included.

    ``sums`` names them. As in ``numbered``, ranges are summed by themselves, and what a group
    has in the ranges before is added from a table of a row per range and group, so a group may
    hold most of the rows. Rows of null groups are a group.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*group, *(F.col(c) if isinstance(c, str) else c for c in order)]
    ranged = materialise(rows.withColumns({f"_v{k}": v for k, v in enumerate(sums.values())}).repartitionByRange(n, *by).withColumn("_range", F.spark_partition_id()), "ranges")
    of = [f"_of{k}" for k in range(len(group))]
    parts = ranged.groupBy(F.col("_range").alias("_at"), *[F.col(g).alias(o) for g, o in zip(group, of, strict=True)]).agg(*[F.sum(f"_v{k}").alias(f"_p{k}") for k in range(len(sums))])
    earlier = Window.partitionBy(*of).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    before = materialise(parts.select("_at", *of, *[F.sum(f"_p{k}").over(earlier).alias(f"_b{k}") for k in range(len(sums))]), "before")
    same = ranged["_range"] == before["_at"]
    for g, o in zip(group, of, strict=True):
        same = same & ranged[g].eqNullSafe(before[o])
    upto = Window.partitionBy("_range", *group).orderBy(*by[len(group) :]).rowsBetween(Window.unboundedPreceding, 0)

    def exact(sum_: Column, k: int) -> Column:
        """Decimals narrow enough that adding two of them drops no digit."""
        kind = ranged.schema[f"_v{k}"].dataType
        return sum_.cast(DecimalType(37, kind.scale)) if isinstance(kind, DecimalType) else sum_

    here = {name: exact(F.sum(f"_v{k}").over(upto), k) + exact(F.coalesce(F.col(f"_b{k}"), F.lit(0)), k) for k, name in enumerate(sums)}
    made = [f"_v{k}" for k in range(len(sums))] + [f"_b{k}" for k in range(len(sums))]
    return ranged.join(before, same).withColumns(here).drop("_range", "_at", *of, *made)
