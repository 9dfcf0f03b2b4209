"""Connected components of an edge table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialise


def _canonical(edges: DataFrame) -> DataFrame:
    return (
        edges.where("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs to ``(node, root)``, one row per node of any edge.

    Each round, every node is renamed to its least neighbour (or itself), edges are renamed
    with it, and loops and repeats go. For node values in no particular order (fingerprints,
    hashes) a round removes a constant share of the nodes, so rounds grow with the logarithm
    of a component's size. ``root`` is the same for all nodes of a component and is one of them.

    Every round's tables are written to the shared folder; aggregates combine before the
    shuffle, so a hub with a third of all edges doesn't load one task. Nulls and self-loops are
    ignored; no edge at all gives an empty table.
    """
    spark = edges.sparkSession
    edges = materialise(_canonical(edges.dropna()), "edges")
    names = None
    while True:
        both = edges.union(edges.select("b", "a"))
        hook = materialise(
            both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")),
            "hook",
        )
        if names is None:
            names = hook.select(F.col("a").alias("node"), F.col("m").alias("root"))
        else:
            names = materialise(
                names.join(hook, names.root == hook.a, "left").select(
                    "node", F.coalesce("m", "root").alias("root")
                ),
                "names",
            )
        renamed = (
            edges.join(hook.select("a", F.col("m").alias("ma")), "a")
            .join(hook.select(F.col("a").alias("b"), F.col("m").alias("mb")), "b")
            .select(F.col("ma").alias("a"), F.col("mb").alias("b"))
        )
        edges = materialise(_canonical(renamed), "edges")
        if edges.isEmpty():
            return names
