from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import langid, queries
from tests.llm.documents import rows, table


def plain_counts(text, orders, bits):
    """Hashed n-grams one by one, in whole numbers of 32 bits."""
    mask, (a, b, c) = (1 << 32) - 1, langid.MIX
    code, gap = [], False
    for x in f" {text.lower()} ":
        letter = not (ord(x) < 97 or 122 < ord(x) < 128)
        if letter:
            code.append(ord(x))
        elif not gap:
            code.append(32)
        gap = not letter
    found = Counter()
    for i in range(len(code)):
        h = 0
        for n in range(orders):
            if i + n >= len(code):
                break
            h = (((h ^ (h >> 15)) * b) + code[i + n] * langid.MIX[n % 3] + n) & mask
            found[((h ^ (h >> 16)) * c & mask) >> (32 - bits)] += 1
    assert a
    return found


@pytest.mark.parametrize("bits", [8, 15, 16, 20])
def test_counts_equal_the_plain_form(bits):
    for text in ("", "a", "Déjà vu, 12 fois!", "x" * 300, "Ünï cødé — 中文 \U0001f600", *(r[1] for r in rows(n=12) if r[1])):
        at, n = langid.ngram_counts(text, 3, bits)
        assert dict(zip(at.tolist(), n.tolist(), strict=True)) == plain_counts(text, 3, bits)
        assert (np.diff(at) > 0).all()


def test_rows_that_are_all_right_have_a_temperature_within_its_bounds():
    z = np.eye(4)[np.arange(200) % 4] * np.linspace(0.5, 1.5, 200)[:, None]
    t = langid.fit_temperature(z, np.arange(200) % 4)
    assert 10 * langid.COLDEST < t < langid.HOTTEST / 10
    p = np.exp(z / t) / np.exp(z / t).sum(axis=1, keepdims=True)
    assert 0.97 < p.max(axis=1).mean() < 0.9999


def test_predictions_equal_the_plain_form_and_scores_differ(spark):
    docs = table(spark, rows(n=200)).where("doc_id is not null")
    model = langid.fit(docs.where(queries.fold() != queries.HELD_OUT))
    assert 10 * langid.COLDEST < model.temperature < langid.HOTTEST / 10
    found = langid.with_language(docs, model).where("lang_pred <> 'und'").collect()
    for r in found:
        counts = plain_counts(r.text, 3, 15)
        x = {k: (1 + math.log(n)) * model.idf[k] for k, n in counts.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        z = [sum(v / norm * float(model.weights[k, c]) for k, v in x.items()) + model.bias[c] for c in range(3)]
        p = [math.exp((v - max(z)) / model.temperature) for v in z]
        best = max(range(3), key=p.__getitem__)
        assert r.lang_pred == model.languages[best]
        assert r.score == pytest.approx(p[best] / sum(p), abs=1e-6)
    scores = [r.score for r in found]
    assert min(scores) < 0.99 and max(scores) < 1 - 1e-9 and len({round(s, 6) for s in scores}) > 20


def test_too_many_languages_raise(spark):
    docs = spark.range(12).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.col("id").cast("string").alias("lang"))
    with pytest.raises(ValueError, match="over 10 languages"):
        langid.fit(docs, most_languages=10)
