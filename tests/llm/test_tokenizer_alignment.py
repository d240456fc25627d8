"""op11 against whole-text encodings and plain counting."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from assay.llm import tokenizer_alignment as T
from assay.llm.queries import QUERIES

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def whole(text: str) -> tuple[list[int], list[int]] | None:
    """Ids of a whole text by both, as the libraries give them; None if one does not give the bytes back."""
    import sentencepiece
    from tokenizers import Tokenizer

    if not hasattr(whole, "a"):
        whole.a = Tokenizer.from_file(A)
        whole.a.encode_special_tokens = True
        whole.b = sentencepiece.SentencePieceProcessor(model_file=B)
        whole.known = T.Tokenizers(A, B)
    a, b = whole.a.encode(" " + text, add_special_tokens=False).ids, whole.b.encode(text)
    want = (" " + text).encode()
    same = b"".join(whole.known.bytes_a[i] for i in a) == want == b"".join(whole.known.bytes_b[i] for i in b)
    return (a, b) if same else None


def spans(ids: list[int], of: list[bytes]) -> list[tuple[int, int, int]]:
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(of[i]), i))
        at += len(of[i])
    return out


def plain(rows: list[tuple]) -> list[tuple]:
    """The contract, pair by pair of overlapping byte ranges."""
    per_row, counts = [], Counter()
    for key, text in rows:
        ids = whole(text) if text else None
        if not ids:
            per_row.append((key, 0, 0, 0, [], ""))
            continue
        a, b = spans(ids[0], whole.known.bytes_a), spans(ids[1], whole.known.bytes_b)
        links, j = [], 0
        for s, e, i in a:
            while b[j][1] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][0] < e:
                links.append((i, b[k][2]))
                k += 1
        cuts = sorted({x[1] for x in a} & {x[1] for x in b})
        groups, last = [], 0
        for c in cuts:
            side = lambda of, last=last, c=c: ",".join(str(i) for s, e, i in of if last < e <= c) if len(of) < 3000 else None
            groups.append((last, c, side))
            last = c
        texts = []
        ia = ib = 0
        for _, c, _ in groups:
            x, y = [], []
            while ia < len(a) and a[ia][1] <= c:
                x.append(str(a[ia][2]))
                ia += 1
            while ib < len(b) and b[ib][1] <= c:
                y.append(str(b[ib][2]))
                ib += 1
            texts.append(f"{','.join(x)}|{','.join(y)}")
        counts.update(links)
        per_row.append((key, len(a), len(b), len(cuts), links, hashlib.sha256(";".join(texts).encode()).hexdigest()))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [(key, na, nb, ng, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), sha) for key, na, nb, ng, links, sha in per_row]


AWKWARD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "\n", "\n\n", "a\n\n b\n", "\ta\tb \t c", "a\r\nb;\r\nc", "foo bar　baz", "x\x1cy \x1d z", "don't can't I'll we've 'tis 's", "a ▁ b", "▁", "<|endoftext|> <s> </s> <unk> <0x0A>",
    "3.14, 1,000.5. e.g. x,y.z ),. ).. _,_ a_, b", "漢字かな交じり文、です。", "안녕 하세요", "\U0001f600\U0001f469‍\U0001f680 ok", "éé, é. é, é.", "\x00\x01", "fi ﬁ Ａ", "a,'s b,'re ...'s", "if (x) {\r\n\treturn a.b, c;\r\n}\r\n", "http://a.b.example/c?d=e&f=1,2", "  lead and trail  ", "tab\t, x .y ,z",
]


def test_words_apart_are_the_words_together():
    known = T.Tokenizers(A, B)
    rng = random.Random(3)
    signs = "aeiouthnstELA059 ,.  \n\t\r'\"()_-;:é漢 \x1c█"
    texts = AWKWARD + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    for t in texts:
        if not t or T.MARK in t:
            continue
        words = known.words(" " + t)
        assert "".join(words) == " " + t
        a = [i for w in words for i in known.a.encode(w, add_special_tokens=False).ids]
        b = [i for w in words for i in known.b.encode(w)]
        assert (a, b) == whole(t), repr(t)


def test_long_runs_are_cut_where_it_does_not_show():
    known = T.Tokenizers(A, B)
    rng = random.Random(5)
    for signs in ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "漢字日本語中文的一是不了人我在有他这為之大來以個上們", "!'?s=re"):
        text = "".join(rng.choice(signs) for _ in range(30_000))
        words = known.words(" " + text)
        assert len(words) > 1 or signs[0] == "!"
        assert "".join(words) == " " + text
        a = [i for w in words for i in known.a.encode(w, add_special_tokens=False).ids]
        assert (a, [i for w in words for i in known.b.encode(w)]) == whole(text)


def test_blocks():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        columns = [rng.integers(0, hi, n) for hi in (1, 200, 70_000, 1 << 40)]
        for got, want in zip(T.unpacked(T.packed(*columns), 4), columns, strict=True):
            assert (got == want).all()


def collected(df) -> list[tuple]:
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=str)


def test_against_plain_counts(spark, sf_dir, table):
    rows = [(None if k != k or k is None else int(k), t) for k, t in zip(table["doc_id"], table["text"], strict=True)]
    assert collected(QUERIES["op11_tokenizer_alignment"](spark, sf_dir)) == sorted(plain(rows), key=str)


@pytest.mark.parametrize("bounds", [{}, {"TOGETHER": 50, "REMEMBERED": 3000, "COUNTED": 20, "GROUP_LINKS": 4, "MEETING": 1}])
def test_awkward_texts(spark, monkeypatch, bounds):
    for k, v in bounds.items():
        monkeypatch.setattr(T, k, v)
    rows = [(i, t) for i, t in enumerate(AWKWARD + [None, "the same " * 200, "the same " * 200])] + [(None, "no key"), (3, "again 3")]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, row string, stripe int").repartition(3)
    stripes = 7 if bounds else T.STRIPES
    if bounds:  # workers do not see what is patched here: in this process
        known = T.Tokenizers(A, B)
        codes = T.Codes(len(known.bytes_a), len(known.bytes_b), stripes)
        out = T.Blocks(codes, 0)
        documents = T.Documents(T.WordTable(known, codes), out)
        for k, t in rows:
            documents.add(k, t or "")
        documents.flush()
        out.counted()
        got = [(r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) for r in out.rows if r["kind"] == T.DOCUMENT]
        assert sorted(got, key=str) == sorted([(r[0], *r[1:5], r[7]) for r in plain(rows)], key=str)
        raw = spark.createDataFrame([tuple(r.get(n.split()[0]) for n in T.SCHEMA.split(", ")) for r in out.rows], T.SCHEMA)
        sums = {r["row"]: (r["b"], r["s"]) for r in T.scored(raw, codes).groupBy("row").agg({"n_best": "sum", "count_sum": "sum"}).toDF("row", "b", "s").collect()}
        keys = {r["row"]: (r["doc_id"], r["groups_sha256"]) for r in out.rows if r["kind"] == T.DOCUMENT}
        assert sorted([(*keys[k], *v) for k, v in sums.items()], key=str) == sorted([(r[0], r[7], r[5], r[6]) for r in plain(rows) if r[1]], key=str)
    assert collected(T.alignment(docs, A, B, stripes=stripes)) == sorted(plain(rows), key=str)


def test_pair_counts(spark):
    docs = spark.createDataFrame([(1, "the cat, the hat"), (2, "the then"), (3, None)], "doc_id long, text string")
    got = {(r["a"], r["b"]): (r["n"], r["best"]) for r in T.pair_counts(docs, A, B).collect()}
    want = Counter()
    for t in ("the cat, the hat", "the then"):
        a, b = whole(t)
        sa, sb = spans(a, whole.known.bytes_a), spans(b, whole.known.bytes_b)
        want.update((i, j) for s, e, i in sa for u, v, j in sb if s < v and u < e)
    most = {j: max(n for (_, x), n in want.items() if x == j) for _, j in want}
    assert got == {k: (n, n == most[k[1]]) for k, n in want.items()}


def test_empty_table(spark, empty_dir):
    assert QUERIES["op11_tokenizer_alignment"](spark, empty_dir).collect() == []
