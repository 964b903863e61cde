"""Chunks of the packing tokenizer: ids as the tokenizer library gives them, each chunk encoded once a call."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import public_tokenizers

from glyphloom.llm import packing


def test_ids_are_the_tokenizers_own():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    parts = ["a", "Thou", "é", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", " ", "漢", "д", "'s", "'", "22", ".", "<P>", "<|endoftext|>", "🙂", " the"]
    rng = random.Random(5)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(20))) for _ in range(2000)] + ["", " ", "a ", " a", "a\n b", "a \nb", "\n"]
    want = [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
    assert packing.file_encoder(path)(texts) == want
    assert packing.file_encoder(path)([]) == []


def test_a_chunk_is_encoded_once_a_call_and_texts_with_runs_are_cut_too():
    given = []

    def encode(chunks: pa.Array) -> pa.Array:
        given.append(chunks.to_pylist())
        return pa.array([[len(c)] for c in chunks.to_pylist()], packing.IDS)

    out = packing.ChunkEncoder(encode)(["a bb bb ccc", "x\n y bb bb"])
    assert [np.frombuffer(o, "<u4").tolist() for o in out] == [[1, 3, 3, 4], [4, 3, 3]]
    assert sorted(map(len, given)) == [3, 4] and all(c.count(" bb") == 1 for c in given)
