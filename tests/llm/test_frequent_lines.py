from __future__ import annotations

import corpus_pipeline
from tests.llm.documents import table


def test_a_line_in_many_texts_of_a_large_host_goes_and_clean_documents_stay(spark):
    body = lambda k: " ".join(f"q{k}x{j}" for j in range(60))
    data = [(k, f"Share  this PAGE\n{body(k)}" if k < 11 else body(k), "aa", "large", 0, 1, "h", 2, "n") for k in range(120)]
    data += [(200 + k, f"in ten texts\n{body(200 + k)}", "aa", "large", 0, 1, "h", 2, "n") for k in range(10)]
    kept = {r.doc_id: r.text for r in corpus_pipeline.quality_rules(spark, table(spark, data), "").collect()}
    assert kept == {r[0]: r[1].removeprefix("Share  this PAGE\n") for r in data}
