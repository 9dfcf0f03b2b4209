from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import langid
from tests.llm.documents import SCHEMA, table


def test_ngrams_see_the_whole_text_and_fold_case():
    one, n = langid.ngram_counts("AbC, abc", 3, 12)
    two, m = langid.ngram_counts("abc abc", 3, 12)
    assert one.tolist() == two.tolist() and n.tolist() == m.tolist()
    assert langid.ngram_counts("a" * 50_000 + "z", 3, 12)[0].tolist() != langid.ngram_counts("a" * 50_001, 3, 12)[0].tolist()
    assert n.sum() == 9 + 8 + 7


def test_ftrl_separates_and_stays_sparse():
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for k in range(200):
        y = k % 3
        at = np.unique(np.append(rng.integers(30, 300, 5), 10 * y + rng.integers(0, 10, 4)))
        rows.append((at, np.ones(len(at)) / np.sqrt(len(at))))
        labels.append(y)
    zeros = []
    for l1 in (0.0, 0.02, 0.5):
        w, b = langid.train_ftrl(rows, np.array(labels), 3, 300, l1=l1)
        assert [int((x @ w[at] + b).argmax()) for at, x in rows] == labels
        zeros.append((w == 0).mean())
    assert zeros[0] < zeros[1] < zeros[2] and zeros[2] > 0.5


def test_temperature_minimises_the_loss():
    rng = np.random.default_rng(1)
    z = rng.normal(size=(4000, 3))
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    labels = np.array([rng.choice(3, p=x) for x in p])
    assert langid.fit_temperature(3 * z, labels) == pytest.approx(3, rel=0.15)
    assert langid.fit_temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0


def test_held_out_accuracy_and_undetermined_texts(spark):
    docs = table(spark).where("doc_id is not null")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = langid.fit(docs.where(fold != 2))
    assert model.languages == ["aa", "bb", "cc"]
    found = langid.with_language(docs.withColumn("score", F.lit("clash")), model)
    assert found.columns == [*docs.columns, "lang_pred", "score"]
    held = found.where((fold == 2) & F.col("lang").isNotNull() & (F.col("lang_pred") != "und"))
    assert held.count() > 10 and held.where("lang <> lang_pred").count() == 0
    assert {r.doc_id for r in found.where("lang_pred = 'und'").collect()} == {80, 81, 82, 83}
    assert found.where("score < 0 or score > 1 or (lang_pred = 'und' and score <> 0)").count() == 0


def test_repeated_keys_are_sampled_once(spark):
    docs = table(spark).where("doc_id is not null and lang = 'aa'").select("text", "lang", F.lit(7).alias("doc_id"))
    others = table(spark).where("doc_id is not null and lang <> 'aa'").select("text", "lang", "doc_id")
    model = langid.fit(docs.union(others))
    assert model.languages == ["aa", "bb", "cc"]
    assert langid.with_language(others, model).where("lang_pred not in (lang, 'und')").count() == 0


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert langid.fit(empty) is None
    assert langid.fit(table(spark).withColumn("lang", F.lit(None).cast("string"))) is None
    found = langid.with_language(table(spark), None)
    assert found.where("lang_pred <> 'und' or score <> 0").count() == 0
    assert langid.with_language(empty, None).count() == 0
