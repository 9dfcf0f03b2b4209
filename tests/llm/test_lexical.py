from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestone.llm import lexical

DOCS, ITEMS = "doc_id long, text string, score long, query string", "item_id long, text string, rank int"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def cut(text):
    return re.findall(TERM, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    """The contract, by scoring every document."""
    counts = [(d[0], Counter(cut(d[1]))) for d in docs]
    counts = [(key, c) for key, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item in items:
        scores = []
        for key, c in counts:
            m = 100 - 90 + (90 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(cut(item[1])) if c[t])
            if s > 0:
                scores.append((-s, key is None, key or 0, key))
        out += [(item[0], rank, x[3], -x[0]) for rank, x in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("Ab", "cé", "x", "ñ7", "q_", "r") for b in range(60)] + ["the", "of"] * 40
    topics = [rng.sample(words, 40) for _ in range(8)]
    docs = []
    for k in range(n):
        text = " ".join(rng.choices(topics[k % 8], k=rng.randint(1, 60)))
        docs.append((k, text if k % 9 else docs[max(0, k - 5)][1] if docs else text))
    docs += [(1000, None), (1001, ""), (1002, "!!! ..."), (None, docs[7][1]), (None, "zz top"), (7, docs[7][1]), (1003, "THE-the/of " * 30_000)]
    items = [(k, " ".join(rng.choices(topics[k % 8], k=rng.randint(1, 25)))) for k in range(40)]
    items += [(100, None), (101, "--"), (102, "unheard words"), (103, "zz"), (3, items[3][1]), (None, items[5][1]), (104, "the of The")]
    return [(*d, 5, "clash") for d in docs], [(*i, 1) for i in items]


@pytest.mark.parametrize("how", [{}, {"shard_docs": 32, "block": 3, "share": 0.3}, {"shard_docs": 7, "block": 2, "share": 0.9, "at_once": 9}, {"k": 3, "block": 1}])
def test_search_equals_scoring_everything(spark, how):
    docs, items = corpus()
    found = lexical.search(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), **how)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, found.collect())) == plain(docs, items, how.get("k", 10))


def test_empty_tables(spark):
    docs, items = corpus(20)
    none, no_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert lexical.search(none, spark.createDataFrame(items, ITEMS)).count() == 0
    assert lexical.search(spark.createDataFrame(docs, DOCS), no_items).count() == 0


def shard(docs=3000, width=400, seed=2):
    """Documents of a few topics, so that lists fall into blocks."""
    rng = np.random.default_rng(seed)
    topic = rng.integers(0, 20, docs)
    rows = [np.unique(np.append(rng.integers(0, 40, 10), 40 + topic[k] * 18 + rng.integers(0, 18, 8))) for k in range(docs)]
    starts = np.append(0, np.cumsum([len(r) for r in rows]))
    x = rng.integers(1, 900_000, starts[-1])
    return lexical.built(rng.permutation(docs), np.full(docs, True), starts, np.concatenate(rows), x, width, 16, 0.125), rows


def test_summaries_are_the_maxima_of_their_blocks_and_lists_are_whole():
    index, rows = shard()
    vectors = [dict(zip(r.tolist(), index.impacts[a:b].tolist(), strict=True)) for r, a, b in zip(rows, index.terms_starts, index.terms_starts[1:], strict=False)]
    for at, t in enumerate(index.lists):
        own = [d for b in range(*index.lists_starts[at : at + 2]) for d in index.members[slice(*index.members_starts[b : b + 2])]]
        assert sorted(own) == ([k for k, v in enumerate(vectors) if t in v] if t >= 0 else list(range(len(vectors))))
    for b in range(len(index.members_starts) - 1):
        most = defaultdict(int)
        for d in index.members[slice(*index.members_starts[b : b + 2])]:
            for t, x in vectors[d].items():
                most[t] = max(most[t], x)
        spots = slice(*index.summary_starts[b : b + 2])
        assert dict(zip(index.summary_terms[spots].tolist(), index.summary_maxima[spots].tolist(), strict=True)) == most
    assert len(index.common) and (index.lists >= 0).sum() + len(index.common) == len({t for r in rows for t in r.tolist()})


def test_blocks_are_alike_and_most_are_skipped(monkeypatch):
    index, rows = shard()
    rng = np.random.default_rng(5)
    asked = [np.unique(np.append(rng.integers(0, 40, 3), 40 + k % 20 * 18 + rng.integers(0, 18, 6))) for k in range(60)]
    queries = lexical.Queries(asked, [np.where(t < 40, 300, 4000) for t in asked], np.zeros(60, np.int64))
    met, real = [], lexical._flat

    def counting(starts, chosen):
        met.append(len(chosen) if starts is index.terms_starts else 0)
        return real(starts, chosen)

    monkeypatch.setattr(lexical, "_flat", counting)
    found = {n: (docs, scores) for n, docs, scores in lexical.searched(index, queries, 400, 10)}
    owner = np.repeat(np.arange(len(rows)), np.diff(index.terms_starts))
    for n, (t, w) in enumerate(zip(queries.terms, queries.weights, strict=True)):
        q = np.zeros(400, np.int64)
        q[t] = w
        scores = np.bincount(owner, q[index.terms] * index.impacts).astype(np.int64)
        best = np.lexsort((index.keys, -scores))[:10]
        assert found[n][0].tolist() == best.tolist() and found[n][1].tolist() == scores[best].tolist()
    assert sum(met) < 0.25 * 60 * len(rows)
