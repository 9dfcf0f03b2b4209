"""The order in which evidence is read: what has been shown least comes next."""

from __future__ import annotations

from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.shared import materialise

#: Roles of evidence that show what users do (fixed values), and those of the other groups.
BEHAVIOUR = ("workflow_pain", "usage_behavior", "creative_output", "learning_progress", "social_sharing", "outsourcing", "payment")
COMMERCIAL, CHALLENGE = ("official_pricing",), ("alternative", "counter_evidence")


def role_group(role: Column) -> Column:
    """behavior, commercial, challenge or unknown."""
    return F.when(role.isin(*BEHAVIOUR), "behavior").when(role.isin(*COMMERCIAL), "commercial").when(role.isin(*CHALLENGE), "challenge").otherwise("unknown")


def quality(semantic: Column, retracted: Column, relevance: Column) -> Column:
    """0 for what a review found relevant, 1 for what nobody has reviewed, 2 for what seems unrelated, 3 for what a review found so or is retracted."""
    gone = F.coalesce(retracted, F.lit(False)) | F.coalesce(semantic == "unrelated", F.lit(False))
    return F.when(gone, 3).when(relevance == "unrelated", 2).when(semantic == "relevant", 0).otherwise(1)


def fair_order(
    rows: DataFrame,
    k: int,
    group: list[str] | None = None,
    key: str = "evidence_id",
    industries: str = "industry_ids",
    families: str = "task_family_ids",
    source: str = "source",
    role: str = "evidence_role",
    grade: str = "quality",
) -> DataFrame:
    """The first ``k`` rows of each group in reading order, with ``position`` from 1.

    Rows of the same industries, tasks, source, role and relatedness are a queue, best ``grade``
    first, then by key. Each time, of all queues' first rows the one comes next whose industry has
    been shown least; then of the group of roles, task, source and role shown least; then of the
    best grade and the least key. Unrelated rows (grade 2 or more) come after all others.

    Only the first ``k`` of a queue can be among the first ``k`` of all, so each group is a choice
    among queues times ``k`` keys, however many rows it has: the longest queue is cut by many
    tasks before it is gathered. Keys are unique in a group and not null; missing industries are
    unclassified, missing tasks and sources unknown, a missing role discovery. Null groups are a
    group.
    """
    group = group or []
    listed = lambda c, none: F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) == 0, F.array(F.lit(none))).otherwise(F.array_sort(F.array_distinct(c)))
    named = lambda c, none: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(none))
    queue = {"x_industries": listed(F.col(industries), "unclassified"), "x_families": listed(F.col(families), "unknown"), "x_source": named(source, "unknown"), "x_role": named(role, "discovery"), "x_late": F.col(grade) >= 2}
    of = [f"x_group{i}" for i in range(len(group))]
    heads = rows.select(*[F.col(g).alias(o) for g, o in zip(group, of, strict=True)], F.col(key).alias("x_key"), F.col(grade).alias("x_grade"), *[v.alias(c) for c, v in queue.items()])
    nth = F.row_number().over(Window.partitionBy(*of, *queue).orderBy("x_grade", "x_key"))
    heads = materialise(heads.withColumn("x_n", nth).where(F.col("x_n") <= k).withColumn("x_roles", role_group(F.col("x_role"))), "heads")
    out = heads.select(*of, "x_key", F.lit(1).alias("position")).schema

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        queues: dict[tuple, list] = {}
        for r in frame.sort_values(["x_grade", "x_key"], ascending=False).itertuples():
            shape = (tuple(r.x_industries), tuple(r.x_families), r.x_source, r.x_role, r.x_roles, bool(r.x_late))
            queues.setdefault(shape, []).append((r.x_grade, r.x_key))
        shown: list[Counter] = [Counter() for _ in range(5)]
        taken = []

        def rank(shape: tuple) -> tuple:
            own, tasks, src, kind, kinds, late = shape
            return (late, min(shown[0][x] for x in own), shown[1][kinds], min(shown[2][x] for x in tasks), shown[3][src], shown[4][kind], *queues[shape][-1])

        while queues and len(taken) < k:
            best = min(queues, key=rank)
            taken.append(queues[best].pop()[1])
            if not queues[best]:
                del queues[best]
            own, tasks, src, kind, kinds, _ = best
            for counter, values in zip(shown, (own, [kinds], tasks, [src], [kind]), strict=True):
                counter.update(values)
        return pd.DataFrame({**{c: [frame[c].iloc[0]] * len(taken) for c in of}, "x_key": taken, "position": range(1, len(taken) + 1)})

    found = materialise(heads.groupBy(*of).applyInPandas(choose, out), "order")
    same = reduce(lambda a, b: a & b, [rows[g].eqNullSafe(found[o]) for g, o in zip(group, of, strict=True)], rows[key] == found["x_key"])
    return rows.join(found, same).drop(*of, "x_key")
