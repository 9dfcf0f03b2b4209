from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm import packing, queries
from tests.llm.documents import table

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WHOLE = public_tokenizers.path("byte_bpe_50k.json")
UNMODIFIED = Tokenizer.from_file(WHOLE)


def want(text):
    return UNMODIFIED.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=20), st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", " ", "\n\n"])), max_size=6))
def test_ids_equal_the_unmodified_tokenizer(parts):
    text = "".join(parts).encode("utf-8", "replace").decode()
    assert packing.ids_of(RANKS, PATTERN, WHOLE)(text).tolist() == want(text)


def test_added_tokens_and_long_white_space_in_the_query(spark, tmp_path):
    texts = ["a<|endoftext|>b", "a" + " " * 1_010_000 + "b", "\n" * 1_010_000, "plain text", None]
    table(spark, [(k, t, "aa", "s", 0, 1, "h", 2, "n") for k, t in enumerate(texts)]).write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.doc_id, r.piece): (r.length, r.ids_crc32) for r in queries.op5_best_fit_packing(spark, str(tmp_path)).collect()}
    expected = {}
    for k, t in enumerate(texts):
        ids = [*want(t or ""), 2]
        for j, (start, n) in enumerate(packing.cut(len(ids), 1024)):
            expected[k, j] = (n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()))
    assert found == expected
