from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.llm import mixing
from tests.llm.documents import SCHEMA, table


@pytest.fixture(scope="module")
def crowded(spark):
    """Null ids and one id over hundreds of rows, some of which are alike, beside plain ones."""
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(1 + k % 20))
    data = [(None, text(k % 250), "aa", "s1", 0, 1, "h", 2, "n") for k in range(300)]
    data += [(7, text(k), "aa", "s2", 0, 1, "h", 2, "n") for k in range(300)]
    data += [(1000 + k, text(k), "aa", "s0" if k % 3 else "s2", 0, 1, "h", 2, "n") for k in range(200)]
    return table(spark, data).repartition(4)


def test_ids_of_many_rows_come_near_their_targets(crowded):
    taken, target = defaultdict(int), {}
    for r in mixing.mixed(crowded).collect():
        taken[r.source] += r.copies * r["size"]
        target[r.source] = r.target
        assert r.copies <= 3
    for source, want in target.items():
        assert taken[source] == pytest.approx(want, rel=0.15)


def test_reruns_and_partitions_agree(crowded):
    one, two = (Counter(map(tuple, mixing.mixed(x).collect())) for x in (crowded, crowded.repartition(7).orderBy("text")))
    assert one == two


def test_the_mix_takes_what_was_counted(crowded):
    want = Counter()
    for r in mixing.mixed(crowded).collect():
        want[r.doc_id, r.source, r["size"]] += r.copies
    found = Counter((r.doc_id, r.source, len(r.text.split())) for r in mixing.mix(crowded).collect())
    assert found == +want


def test_first_rows_draw_as_ids_alone_do(spark):
    u = spark.range(50).select(mixing.uniform(F.col("id"), 20).alias("a"), mixing.uniform(F.col("id"), 20, F.lit(1)).alias("b"), mixing.uniform(F.col("id"), 20, F.lit(2)).alias("c"))
    rows = u.collect()
    assert all(r.a == r.b for r in rows) and sum(r.a == r.c for r in rows) == 0


def test_no_documents_at_all(spark):
    assert mixing.mixed(spark.createDataFrame([], SCHEMA)).count() == 0
