from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from assay.llm import packing
from assay.llm.queries import op10_packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_remembered_words_give_the_tokenizers_ids(tokenizer):
    rng = random.Random(9)
    alphabet = "abcDEZ  019'’s.,-_éßİıſK漢☃́\x1c\x85\xa0　\n\t<|>|endoftext"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3_000)] + ["<|endoftext|> x", "don't we'll I'VE", "a<|startoftext|>b"]
    for text, ids in zip(texts, packing.WordEncoder(PATH).encode(pa.array(texts)), strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_query_places_every_piece_once(spark, sf_dir, empty_dir, table, tokenizer):
    want = []
    for k, t in zip(table.doc_id, table.text, strict=True):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(str(k), i, 4096 * i, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for i, p in enumerate(ids[a : a + 4096] for a in range(0, len(ids), 4096))]
    got = op10_packing(spark, sf_dir).collect()
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= -(-sum(w[3] for w in want) // 4096) + 2
    assert op10_packing(spark, empty_dir).count() == 0


def plain_best_fit(lengths: list[int], capacity: int) -> int:
    gaps: list[int] = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(capacity - n)
        else:
            gaps[gaps.index(fit)] = fit - n
    return len(gaps)


def test_plan_uses_no_more_sequences_than_best_fit(spark):
    rng = random.Random(10)
    for trial in range(200):
        capacity = rng.choice([30, 100])
        low, high = rng.choice([(1, capacity), (capacity // 3 + 1, capacity), (1, capacity // 4), (capacity // 3, capacity // 2 + 1)])
        lengths = [rng.randint(low, high) for _ in range(rng.randint(0, 80))] + [rng.choice([1, capacity // 2, capacity])] * rng.randint(0, 30)
        placed = packing.plan(dict(Counter(lengths)), capacity)
        filled, ranks = defaultdict(list), defaultdict(list)
        for length, rank, n, first, offset in placed.tolist():
            ranks[length] += range(rank, rank + n)
            for s in range(first, first + n):
                filled[s].append((offset, length))
        assert {k: len(v) for k, v in ranks.items()} == dict(Counter(lengths)) and all(sorted(v) == list(range(len(v))) for v in ranks.values())
        for pieces in filled.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= capacity
            assert sum(3 * length > capacity for _, length in pieces) <= 2
        assert len(filled) <= plain_best_fit(lengths, capacity) + 1, (trial, lengths)
