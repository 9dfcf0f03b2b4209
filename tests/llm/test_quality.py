from __future__ import annotations

import re
from collections import Counter, defaultdict

from lodestone.llm import quality
from tests.llm.documents import SCHEMA, table


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(repeated),
    }


def normal(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" ").lower()


def verdicts(data, least, share):
    docs, lines = defaultdict(set), defaultdict(set)
    for r in data:
        docs[r.source].add(r.text or "")
        for x in (r.text or "").split("\n"):
            if x.strip():
                lines[r.source, normal(x)].add(r.text)
    common = {k for k, v in lines.items() if len(v) > least and len(v) > share * len(docs[k[0]])}
    for r in data:
        p = plain(r.text)
        gone = sum(len(x.split()) for x in (r.text or "").split("\n") if (r.source, normal(x)) in common)
        failed = p["n_words"] < 50 or 100 * p["n_repeat_words"] > 50 * p["n_words"]
        yield failed, not failed and gone <= 0.5 * p["n_words"], gone


EXTRA = ["a b c a b c a b c", "a b a b a", "x\nx\n \n\ny\nX", "|<>| # 100% nbsp", "one\ttwo\x0bthree\x0cfour\rfive", "a a a a"]


def test_counts_equal_the_plain_form(spark):
    data = [(200 + k, t, "aa", "s0", 0, 1, "h", 2, "n") for k, t in enumerate(EXTRA)]
    docs = table(spark).unionByName(table(spark, data))
    rows = quality.measured(docs, ["doc_id", "text"])
    found = quality.judged(rows).collect()
    assert len(found) == docs.count()
    for r in found:
        assert {k: r[k] for k in plain(r.doc.text)} == plain(r.doc.text), r.doc.text


def test_verdicts_equal_brute_force(spark):
    common = " ".join(f"w{k}" for k in range(60))
    data = [(300 + k, f"{common}\nown {k} " + "tail " * (k % 3) * 1, "aa", "big", 0, 1, "h", 2, "n") for k in range(8)]
    data += [(400 + k, common, "aa", "copies", 0, 1, "h", 2, "n") for k in range(20)]
    docs = table(spark).unionByName(table(spark, data))
    found = quality.judged(quality.measured(docs, ["doc_id"]), least=3, share=0.2).collect()
    want = Counter((r.doc_id, *v) for r, v in zip(docs.collect(), verdicts(docs.collect(), 3, 0.2), strict=True))
    assert Counter((r.doc.doc_id, r.base_failed, r.kept, r.n_removed) for r in found) == want
    by_id = {r.doc.doc_id: r for r in found}
    assert not by_id[300].kept and not by_id[300].base_failed  # depleted
    assert by_id[400].kept  # copies of one text don't make its line frequent


def test_frequent_lines_go_and_columns_stay(spark):
    data = []
    for k in range(12):
        body = " ".join(f"q{k}x{j}" for j in range(60))
        data.append((k, f"The  SAME line\n{body}\n", "aa", "s", 0, 1, "h", 2, "n"))
    kept = quality.filtered(table(spark, data))
    assert kept.columns == table(spark).columns
    texts = [r.text for r in kept.collect()]
    assert len(texts) == 12 and not any("SAME" in t for t in texts)
    assert all(t.startswith("q") and t.endswith("\n") for t in texts)


def test_no_documents(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.judged(quality.measured(empty, ["doc_id"])).count() == 0
    assert quality.filtered(empty).count() == 0
