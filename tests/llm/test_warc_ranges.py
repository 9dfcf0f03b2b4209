from __future__ import annotations

import gzip
import os
import random
import zlib

import pytest

from lodestone.llm import warc


def archive(rng, levels):
    """Records of which some hold archives, stored so that the bytes of these can be found by their magic."""
    contents = []
    for k in range(12):
        payload = rng.randbytes(rng.randint(0, 3_000))
        if k % 4 == 2 and levels:
            payload = b"".join(gzip.compress(c, 0) for c in archive(rng, levels - 1))
        if k == 7:
            payload = warc.MAGIC + b"junk" + gzip.compress(b"WARC/1.0\r\nWARC-Type: none\r\n\r\n", 0)[:-3] + warc.MAGIC
        contents.append(warc.record(f"{levels}-{k}", "u", payload, len(payload), "", None, False))
    return contents


def stored(path, contents, level):
    data = b"".join(gzip.compress(c, level) for c in contents)
    path.write_bytes(data)
    return f"file://{path}", len(data), len(contents)


@pytest.mark.parametrize("level", [0, 6])
def test_an_archive_of_archives_gives_the_same_records_at_every_split(spark, tmp_path, level):
    contents = archive(random.Random(5), 2)
    one = stored(tmp_path / "one.warc.gz", contents, level)
    two = stored(tmp_path / "two.warc.gz", contents[:3], level)
    archives = spark.createDataFrame([one, two, (f"file://{tmp_path}/none", 0, 0)], "path string, size long, records long")
    want = sorted([f"2-{k}" for k in range(12)] + [f"2-{k}" for k in range(3)])
    for split in (997, 5_000, 30_000, 10_000_000):
        found = warc.read_warc(spark, archives, split=split).collect()
        assert sorted(r.record_id for r in found) == want, split


def test_candidates_within_a_payload_are_seen_and_not_taken(spark, tmp_path):
    inner = b"".join(gzip.compress(warc.record(f"in-{k}", "u", b"x" * 50, 50, "", None, False), 0) for k in range(40))
    path, size, _ = stored(tmp_path / "a.warc.gz", [warc.record("out", "u", inner, len(inner), "", None, False), warc.record("last", "u", b"", 0, "", None, False)], 0)
    with open(tmp_path / "a.warc.gz", "rb") as raw:
        file = type("F", (), {"read_at": lambda self, n, at: (raw.seek(at), raw.read(n))[1]})()
        assert len(list(warc.candidates(file, size, 0, size))) > 30
    archives = spark.createDataFrame([(path, size, 2)], "path string, size long, records long")
    rows = warc.read_warc(spark, archives, split=700).collect()
    assert sorted(r.record_id for r in rows) == ["last", "out"]


@pytest.mark.parametrize("spoil", [lambda d: d[:-5], lambda d: d + b"more", lambda d: b"less" + d, lambda d: d[: len(d) // 2] + b"\0" * 9 + d[len(d) // 2 :]])
def test_a_broken_archive_raises(spark, tmp_path, spoil):
    rng = random.Random(1)
    data = spoil(b"".join(gzip.compress(warc.record(k, "u", rng.randbytes(500), 500, "", None, False)) for k in range(9)))
    (tmp_path / "b.warc.gz").write_bytes(data)
    archives = spark.createDataFrame([(f"file://{tmp_path}/b.warc.gz", os.path.getsize(tmp_path / "b.warc.gz"), 9)], "path string, size long, records long")
    for split in (400, 1 << 20):
        with pytest.raises(EOFError, match="whole WARC records"):
            warc.read_warc(spark, archives, split=split)


def test_members_that_spread_are_decoded_by_blocks():
    data = gzip.compress(warc.record(1, "u", b"\0" * 50_000_000, 50_000_000, "", None, False))
    file = type("F", (), {"read_at": lambda self, n, at: data[at : at + n]})()
    assert list(warc.candidates(file, len(data), 0, len(data))) == [(0, len(data))]
    assert max(len(x) for x, _ in warc._parts(warc._Span(file, len(data)), 0)) <= warc.BLOCK
    assert zlib.crc32(warc._member(warc._Span(file, len(data)), 0)[0]) == zlib.crc32(gzip.decompress(data))
