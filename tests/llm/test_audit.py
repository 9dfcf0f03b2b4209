from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import audit
from lodestone.llm.queries import op13_filter_audit

LETTERS = "ABCDE"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain(docs, labels):
    """The contract, a document and an order at a time."""
    labels = [x for x in labels if x[0] is not None]  # a null key has no label
    good = {k for k, quality, _ in labels if quality == 1}
    toxic = {k for k, _, bad in labels if bad == 1}
    fails = []
    for key, text, lang, _, _ in docs:
        t = text or ""
        w = t.replace("\t", " ").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        found = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": key is not None and any(k is not None and k < key and (u or "") == t for k, u, *_ in docs),
        }
        fails.append((lang or "", key, {x for x in LETTERS if found[x]}))
    rows = {}
    for part in {p for p, *_ in fails}:
        own = [(k, f) for p, k, f in fails if p == part]
        taken = Counter()
        for order in map("".join, itertools.permutations(LETTERS)):
            for step, letter in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [k for k, f in own if letter in f and not f & before]
                taken[letter] += len(gone)
                kept = sum(not f & (before | {letter}) for _, f in own)
                redundant = sum(letter in f and bool(f & before) for _, f in own)
                alone = sum(f == {letter} for _, f in own)
                rows[part, order, step] = [kept, len(gone), redundant, alone, sum(k in good for k in gone), sum(k in toxic for k in gone)]
        for (p, order, step), row in rows.items():
            if p == part:
                row.append(taken[order[step - 1]])
    return {k: tuple(v) for k, v in rows.items()}


def corpus():
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(300)]
    docs = []
    for k in range(60):
        n = rng.choice([3, 150, 210, 260])
        text = " ".join(rng.choices(vocabulary if rng.random() < 0.7 else vocabulary[:40], k=n))
        if rng.random() < 0.3:
            text = text.upper()
        if rng.random() < 0.3:
            text += " a|b\n#"
        docs.append((k, text, rng.choice(["en", "de", None]), "s", 0))
    docs += [(100 + k, docs[rng.randrange(20)][1], rng.choice(["en", "de"]), "s", 0) for k in range(30)]
    docs += [(200, None, "en", "s", 0), (201, "", "fr", "s", 0), (None, "", "fr", "s", 0), (None, docs[0][1], "en", "s", 0), docs[3], docs[100 - 40], (300, "x" * 200_000, "en", "s", 0)]
    labels = [(k, k % 2, int(k % 5 == 0)) for k in range(0, 130, 3)] + [(6, None, 1), (6, 1, None), (None, 1, 1), (999, 1, 1)]
    return docs, labels


def written(spark, tmp_path, docs, labels):
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return op13_filter_audit(spark, str(tmp_path))


def test_all_orders_equal_a_plain_count(spark, tmp_path):
    docs, labels = corpus()
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    rows = written(spark, tmp_path, docs, labels).collect()
    assert len(rows) == len({(r.part, r.filter_order, r.step) for r in rows})
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in columns) for r in rows} == plain(docs, labels)


def test_empty_tables(spark, tmp_path):
    assert written(spark, tmp_path, [], []).count() == 0


def test_the_sketch_clears_unique_texts_only(spark):
    n = 30_000
    rows = spark.range(n).select("id", F.xxhash64(F.when(F.col("id") % 10 == 0, F.col("id") % 500).otherwise(F.col("id"))).alias("h"))
    for cells, least in ((1 << 28, 0.98), (1 << 16, 0)):
        found = audit.possible_repeats(rows, "h", most_cells=cells, flush=1000)
        assert found.count() == n and found.where("not possible and id % 10 = 0").count() == 0
        assert found.where("not possible").count() >= least * 0.9 * n


def test_cells_of_a_text_differ():
    rng = np.random.default_rng(0)
    cells = audit._cells(rng.integers(0, 50, 5000), rng.integers(-(1 << 62), 1 << 62, 5000))
    assert all(len(set(x)) == audit.TOUCHED for x in cells.tolist()) and cells.min() >= 0


def test_filters_without_repeats_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 1), (2, "b", "y", 2), (3, None, "x", None)], "doc_id long, text string, mask string, part int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    filters = {"P": F.col("text").contains("a"), "Q": F.length("text") < 2}
    found = audit.audited(docs, labels, filters, part="mask").where("filter_order = 'PQ'").orderBy("part", "step")
    assert [(r.part, r.step, r.kept, r.removed, r.shapley) for r in found.collect()] == [("x", 1, 1, 1, 2), ("x", 2, 1, 0, 0), ("y", 1, 1, 0, 0), ("y", 2, 0, 1, 2)]
