from __future__ import annotations

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from lodestone.sources import recorded

DAY = "2026-07-14"


def lines(n, first=0):
    return [json.dumps({"source": ("a", "b", "c")[k % 3], "request_id": f"r{k}", "query_group": "g", "observed_at": DAY, "response": {"k": k, "t": "é" * (k % 40)}}, ensure_ascii=False) for k in range(first, first + n)]


def loaded(spark, path, **options):
    recorded.register(spark)
    return spark.read.format("recorded_responses").options(path=str(path), **options).load()


@pytest.mark.parametrize("split", [1, 7, 100, 333, 1 << 20])
def test_every_split_gives_each_line_once(spark, tmp_path, split):
    (tmp_path / "in").mkdir()
    texts = lines(60)
    (tmp_path / "in/one.jsonl").write_text("\n".join([*texts[:40], "", "{broken", "[1]"]) if split > 1 else "\n".join(texts[:5]))
    (tmp_path / "in/two.jsonl").write_text("\r\n".join(texts[40:]) + "\n" if split > 1 else "")
    (tmp_path / "in/_SUCCESS").write_text("")
    got = loaded(spark, f"file://{tmp_path}/in", split=split).collect()
    want = texts if split > 1 else texts[:5]
    assert sorted(r.request_id for r in got if not r.problem) == sorted(json.loads(t)["request_id"] for t in want)
    assert {(r.request_id, r.response, r.observed_at) for r in got if not r.problem} == {(x["request_id"], json.dumps(x["response"], ensure_ascii=False, separators=(",", ":")), date(2026, 7, 14)) for x in map(json.loads, want)}
    assert sorted(r.response for r in got if r.problem) == (["[1]", "{broken"] if split > 1 else [])


def test_conditions_on_the_source_are_pushed_down(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one.jsonl").write_text("\n".join(lines(30)))
    rows = loaded(spark, tmp_path / "in")
    for condition, n in ((F.col("source") == "a", 10), (F.col("source").isin("a", "b"), 20), ((F.col("source") == "a") & (F.col("request_id") == "r3"), 1)):
        found = rows.where(condition)
        assert found.count() == n
    plan = rows.where("source = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "(source" not in plan.split("BatchScan")[0].replace("isnotnull(source", "") and "PushedFilters: [source IS NOT NULL]" not in plan


def test_a_stream_reads_files_that_come_later(spark, tmp_path):
    recorded.register(spark)
    (tmp_path / "in").mkdir()

    def run():
        stream = spark.readStream.format("recorded_responses").option("path", str(tmp_path / "in")).option("split", 200).load()
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        return sorted(r.request_id for r in spark.read.parquet(f"{tmp_path}/out").collect())

    (tmp_path / "in/one.jsonl").write_text("\n".join(lines(10)))
    assert len(run()) == 10
    (tmp_path / "in/another.jsonl").write_text("\n".join(lines(5, 10)))
    assert run() == sorted(f"r{k}" for k in range(15)) == run()


def test_no_files_and_no_path(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert loaded(spark, tmp_path / "in").count() == 0
    with pytest.raises(Exception, match="needs a path"):
        spark.read.format("recorded_responses").load().count()
