from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm import packing
from tests.llm.documents import SCHEMA, table

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def reference_tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_ranks_give_the_tokenizers_ids(text):
    text = text.encode("utf-8", "replace").decode()
    ids = packing.encoder(RANKS, PATTERN).encode_to_numpy(text, disallowed_special=())
    assert ids.tolist() == reference_tokenizer().encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_plans_pack_everything_once(sizes):
    bins = packing.plan_bins(Counter(sizes), 40)
    packed = Counter()
    for content, n in bins:
        assert n > 0 and sum(size * times for size, times in content) <= 40
        for size, times in content:
            packed[size] += times * n
    assert packed == Counter(sizes)
    assert sum(n for _, n in bins) <= sum(n for _, n in packing.best_fit(Counter(sizes), 40)) + 1


def exact(sizes, capacity):
    """Fewest bins, by trying all ways."""
    best = [len(sizes)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(rooms)
            return
        for room in {r for r in rooms if r >= sizes[k]}:
            at = rooms.index(room)
            place(k + 1, rooms[:at] + [room - sizes[k]] + rooms[at + 1 :])
        place(k + 1, rooms + [capacity - sizes[k]])

    place(0, [])
    return best[0]


def test_the_reduction_keeps_an_optimum():
    rng = random.Random(2)
    for _ in range(60):
        sizes = sorted((rng.randint(1, 20) for _ in range(9)), reverse=True)
        fixed, left = packing.reduce_by_dominance(Counter(sizes), 20)
        rest = sorted(Counter(left).elements(), reverse=True)
        assert sum(n for _, n in fixed) + exact(rest, 20) == exact(sizes, 20)


def test_cut_leaves_only_the_first_piece_short():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)]
    assert packing.cut(8, 4) == [(0, 4), (4, 4)]
    assert packing.cut(3, 4) == [(0, 3)]


def test_pieces_spell_the_documents_and_fill_sequences(spark):
    docs = table(spark)
    packed = packing.pack(docs, RANKS, PATTERN, capacity=256, with_ids=True)
    encode, want = reference_tokenizer().encode, Counter()
    for r in docs.collect():
        ids = [*encode(r.text or "", add_special_tokens=False).ids, 2]
        for k, (start, n) in enumerate(packing.cut(len(ids), 256)):
            want[r.doc_id, k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())] += 1
    found, places = packed.collect(), defaultdict(list)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    for r in found:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        end = 0
        for offset, n in sorted(spans):
            assert offset == end
            end += n
        assert end <= 256
    whole = packing.sequences(packed).collect()
    assert len(whole) == len(places)
    assert sum(len(r.ids) for r in whole) == sum(r.length for r in found)


def test_no_documents(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), RANKS, PATTERN).count() == 0
