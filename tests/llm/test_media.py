from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import media
from tests.llm.documents import SCHEMA, table


def gear(data):
    h, out = 0, []
    for k, b in enumerate(data):
        h = (h << 1) + int(media.GEAR[b])
        if k >= 32:  # what is older has been shifted out of 32 bits
            h &= (1 << 64) - 1
        out.append(h & 0xFFFFFFFF)
    return out


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=200))
def test_rolling_hash_equals_the_byte_by_byte_form(data):
    import numpy as np

    assert media.rolling_gear(np.frombuffer(data, np.uint8)).tolist() == gear(data)


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=400), st.integers(0, 10))
def test_cuts_keep_the_limits(data, seed):
    data = data * (seed * 10 + 1)
    ends = media.cut_points(data, least=16, target_bits=5, most=128)
    sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    assert ends[-1] == len(data) and all(0 < n <= 128 for n in sizes) and all(n >= 16 for n in sizes[:-1])


def test_cuts_depend_on_content_not_on_place():
    rng = random.Random(4)
    data = rng.randbytes(60_000)
    ends = {n for n in media.cut_points(data)}
    moved = {n - 777 for n in media.cut_points(rng.randbytes(777) + data)}
    assert len(ends & moved) > len(ends) // 2


def test_round_trip(spark):
    docs = table(spark)
    found = media.round_trip(docs, with_bytes=True).collect()
    want = Counter()
    for r in docs.collect():
        data = (r.text or "").encode()
        padded = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        sha = hashlib.sha256(padded).hexdigest()
        want[r.doc_id, len(data), len(padded), sha, zlib.crc32(padded[-64:]), len(padded), sha, padded] += 1
    assert Counter((*r[:7], bytes(r.media)) for r in found) == want
    assert len({r.feature for r in found if r.n_bytes == 0}) == 1


def test_chunks_are_stored_once_by_digest(spark, tmp_path):
    text = "".join(random.Random(1).choices("abcdefghij klmnop", k=20_000))
    data = [(k, text + str(k % 2), "aa", "s", 0, 1, "h", 2, "n") for k in range(40)]
    chunks = media.write_chunks(table(spark, data).repartition(4), f"file://{tmp_path}", "doc_id", "text")
    lists = media.recipes(chunks, "doc_id").collect()
    places = {(p.pack, p.offset) for r in lists for p in r.parts}
    assert len(places) == chunks.select("digest").distinct().count()


def test_no_documents(spark):
    assert media.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
