from __future__ import annotations

import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from lodestone.functions import shared
from lodestone.plans import funnel_queries, operator_queries, queries  # noqa: F401  (the first two add to the registry)

ROOT = Path(__file__).resolve().parents[1]


def session(master, named=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named), sparkContext=SimpleNamespace(master=master, applicationId="a"))


def test_a_cluster_must_name_its_folder():
    for master in ("spark://host:7077", "yarn", "k8s://https://host"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared.shared_folder(session(master))


def test_sessions_release_their_own_files(spark):
    other = spark.newSession()
    shared.release(spark), shared.release(other)
    mine, theirs = shared.materialise(spark.range(3), "mine"), shared.materialise(other.range(4), "theirs")
    assert mine.count() == 3
    assert shared.release(spark) == 1 and theirs.count() == 4 and shared.release(other) == 1


@pytest.mark.parametrize("left", ["", "raise ImportError('no such module')\n"])
def test_the_entry_imports_without_the_training_data_operators(tmp_path, left):
    """A left-over folder without its modules, or one that can't be imported, takes no other query away."""
    (tmp_path / "lodestone").mkdir()
    for part in (ROOT / "lodestone").iterdir():
        if part.name not in ("llm", "__pycache__"):
            (tmp_path / "lodestone" / part.name).symlink_to(part)
    (tmp_path / "lodestone" / "llm").mkdir()
    (tmp_path / "lodestone" / "llm" / "__init__.py").write_text(left)
    (tmp_path / "__spark_entry__.py").symlink_to(ROOT / "__spark_entry__.py")
    code = f"import sys; sys.path.insert(0, {str(tmp_path)!r}); import importlib.util as u; s = u.spec_from_file_location('e', {str(tmp_path / '__spark_entry__.py')!r}); m = u.module_from_spec(s); s.loader.exec_module(m); q = m.queries(); print(len(q), any(n.startswith('op') for n in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 80 and out[1] == "False"


def test_costly_rows_of_one_row_group_are_dealt_over_many_tasks(spark):
    """A table of one row group gave one task, and an aggregate of few bytes few; neither may be made fewer again."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        for query in (queries.QUERIES["redactions"], queries.QUERIES["schema_problems"], queries.QUERIES["evidence_tiers"]):
            assert query(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 7
    finally:
        spark.conf.set(name, before)
