from __future__ import annotations

import gzip
import io
import random
from collections import Counter

import pytest

from lodestone.llm import warc
from tests.llm.test_warc import SCHEMA, want


def test_pages_of_very_long_urls_come_back(spark):
    letters = "".join(random.Random(1).choices("abcdefghijklmnop", k=3_000_000))
    rows = [(1, "u" * 70_000, "a", "d", "o"), (2, " " * 30_000, "b", "d", "o"), (3, letters, "c", "d", "o"), (4, "short", "a", "d", "o")]
    found = warc.round_trip(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter(map(tuple, found)) == Counter(want(rows))


def test_a_long_header_is_found_from_every_split():
    contents = [warc.record(k, "ab c" * n, b"x", 1, "d", None, False) for k, n in enumerate((1, 15_000, 40_000, 2))]
    # Long beginnings of records without an end of the header aren't any.
    contents[3] = warc.record(3, "u", gzip.compress(b"WARC/1.1\r\nWARC-Type: " + b"y" * 200_000, 0), 1, "d", None, False)
    data = b"".join(gzip.compress(c, 0) for c in contents)
    for split in (50_000, 70_001, len(data)):
        with io.BytesIO(data) as raw:
            file = type("F", (), {"read_at": lambda self, n, at, raw=raw: (raw.seek(at), raw.read(n))[1]})()
            found = [c for start in range(0, len(data), split) for _, c in warc.members(file, len(data), start, min(start + split, len(data)))]
        assert found == contents


def test_fewer_records_than_written_raise(spark, tmp_path):
    rows = [(k, "u", f"page {k}", "d", "o") for k in range(5)]
    archives = warc.write_warc(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}")
    found = warc.read_warc(spark, archives)
    assert warc.all_read(found, archives).count() == 5
    with pytest.raises(ValueError, match="records"):
        warc.all_read(found.where("record_id <> '3'"), archives)
