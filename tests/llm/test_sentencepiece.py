from __future__ import annotations

import hashlib
import math
import random
import zlib

import public_tokenizers
import pytest

from assay.llm import sentencepiece_unigram as sp
from assay.llm.queries import op6_sentencepiece


@pytest.fixture(scope="module")
def vocabulary():
    return sp.Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model"))


def plain(v: sp.Vocabulary, text: str) -> float:
    """The best sum of scores, character by character over the whole text."""
    if not text:
        return 0.0
    scores = {}
    for i, piece in enumerate(v.bytes_of):
        if i not in set(v.byte_ids.values()) and piece:
            scores[piece.decode()] = v.scores[i]
    body = " " + text
    best = [0.0] + [-math.inf] * len(body)
    longest = max(map(len, scores))
    for i in range(len(body)):
        for j in range(i + 1, min(len(body), i + longest) + 1):
            if body[i:j] in scores and "▁" not in body[i:j]:
                best[j] = max(best[j], best[i] + scores[body[i:j]])
        if body[i] not in scores or body[i] == "▁":
            best[i + 1] = max(best[i + 1], best[i] + v.lowest - sp.FALLBACK)
    return best[-1]


def score(v: sp.Vocabulary, ids: list[int]) -> float:
    """The sum of ids' scores; a character's byte pieces cost once."""
    total, by_byte = 0.0, {i: b for b, i in v.byte_ids.items()}
    for i in ids:
        if i not in by_byte:
            total += v.scores[i]
        elif by_byte[i] & 0xC0 != 0x80:
            total += v.lowest - sp.FALLBACK
    return total


def test_segments_reach_the_best_sum_of_the_whole(vocabulary):
    import numpy as np

    rng, encoder = random.Random(2), sp.Encoder(vocabulary)
    texts = ["".join(rng.choice("abcdeth  ingé\n☃漢1") for _ in range(rng.randint(0, 14))) for _ in range(12)] + ["", " ", "   ", "hello  world", "\n\n", "the internationalization"]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        found = np.frombuffer(ids, "<i4").tolist()
        assert math.isclose(score(vocabulary, found), plain(vocabulary, text), rel_tol=1e-9), text
        assert vocabulary.decode(found) == text


def test_trie_holds_exactly_its_keys():
    rng = random.Random(4)
    keys = {bytes(rng.choice(b"ab\xff\x00c") for _ in range(rng.randint(1, 6))): i for i in range(300)}
    trie = sp.Trie.build(keys)
    for _ in range(3_000):
        word, node = bytes(rng.choice(b"ab\xff\x00c") for _ in range(rng.randint(1, 7))), 0
        for c in word:
            child = trie.base[node] + c
            if trie.check[child] != node:
                node = -1
                break
            node = child
        assert (trie.value[node] if node > 0 else -1) == keys.get(word, -1)


def test_query_gives_every_text_back(spark, sf_dir, empty_dir, table):
    got = sorted((str(r["doc_id"]), r["decoded_sha256"]) for r in op6_sentencepiece(spark, sf_dir).collect())
    assert got == sorted((str(k), hashlib.sha256((t or "").encode()).hexdigest()) for k, t in zip(table.doc_id, table.text, strict=True))
    assert op6_sentencepiece(spark, empty_dir).count() == 0


def test_query_digests_are_those_of_the_ids(spark, sf_dir, docs):
    model = public_tokenizers.path("piece_bpe_32k.model")
    ids = sp.encode(docs.select("doc_id", "text", "score"), model)
    assert ids.columns == ["doc_id", "score", "ids"]
    want = sorted((str(r["doc_id"]), len(r["ids"]), zlib.crc32(",".join(map(str, r["ids"])).encode())) for r in ids.collect())
    assert sorted((str(r["doc_id"]), r["n_ids"], r["ids_crc32"]) for r in op6_sentencepiece(spark, sf_dir).collect()) == want


def test_decoding_bytes_and_invalid_ids(spark, vocabulary):
    assert vocabulary.decode([vocabulary.byte_ids[0xFF]]) == "�"
    assert vocabulary.decode([]) == ""


def test_long_runs_without_spaces(vocabulary):
    """Base64, signs of many scripts and one letter over and over: the best sum, and time by the length."""
    import time

    import numpy as np

    rng, encoder = random.Random(8), sp.Encoder(vocabulary)
    draw = lambda signs, n: "".join(rng.choice(signs) for _ in range(n))
    base64, mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "的一是不了人我在有他กขคงあいうえお漢字"
    for text in (draw(base64, 300), draw(mixed, 300), "q" * 150, draw(base64, 90) + " " + draw(mixed, 90)):
        (ids,) = encoder.encode([text])
        found = np.frombuffer(ids, "<i4").tolist()
        assert math.isclose(score(vocabulary, found), plain(vocabulary, text), rel_tol=1e-9) and vocabulary.decode(found) == text
    start = time.monotonic()
    text = draw(base64, 1_000_000)
    (ids,) = encoder.encode([text])
    assert vocabulary.decode(np.frombuffer(ids, "<i4").tolist()) == text and time.monotonic() - start < 60
    assert not any(len(s) > sp.LONG for s in encoder.known)
