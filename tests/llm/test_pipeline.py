from __future__ import annotations

from collections import Counter, defaultdict

import corpus_pipeline
from lodestone.llm import common, mixing, simhash
from lodestone.llm.common import materialise
from tests.llm.documents import SCHEMA, rows, table
from tests.llm.test_mixing import plain_targets
from tests.llm.test_quality import verdicts
from tests.llm.test_simhash import plain


def test_stages_act_on_what_the_one_before_kept(spark, tmp_path):
    table(spark, [r[:5] + (1, "h", 2, "n") for r in rows(n=150)]).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "quality_rules", "near_duplicates", "source_mix", "best_fit_packing"]
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(materialise(stage(spark, seen[-1], str(tmp_path)), name))
        assert seen[-1].columns == docs.columns
    ids = [Counter(r.doc_id for r in x.collect()) for x in seen]
    without = {r.doc_id for r in docs.collect() if not any(c.isalpha() for c in r.text or "")}
    assert set(ids[0]) - set(ids[1]) == without
    good = Counter(r.doc_id for r, v in zip(seen[1].collect(), verdicts(seen[1].collect(), 10, 0.2), strict=True) if v[1])
    assert ids[2] == good
    groups = {r.component_id for r in simhash.near_duplicates(seen[2]).collect()}
    assert set(ids[3]) == groups and set(ids[3].values()) == {1}
    prints = [plain(r.text) for r in seen[3].collect()]
    assert all((a ^ b).bit_count() > 4 for k, a in enumerate(prints) for b in prints[:k])
    sizes = defaultdict(int)
    for r in seen[3].collect():
        sizes[r.source] += len(r.text.split())
    target = plain_targets(sizes)
    copies = {r.doc_id: r for r in mixing.mixed(seen[3]).collect()}
    assert all(abs(r.target - target[r.source]) < 1e-6 for r in copies.values())
    assert ids[4] == +Counter({k: r.copies for k, r in copies.items()})
    packed = corpus_pipeline.STAGES[-1][1](spark, seen[4], str(tmp_path)).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == ids[4]
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert Counter(tuple(r[c] for c in columns) for r in whole) == Counter(tuple(r[c] for c in columns) for r in packed)


def test_shared_files_can_be_released(spark):
    common.release(spark)
    kept = materialise(spark.range(3).toDF("n"), "kept")
    assert kept.count() == 3 and common.release(spark) == 1 and common.release(spark) == 0


def test_an_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
