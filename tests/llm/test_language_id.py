from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest

from assay.llm import language_id
from assay.llm.queries import op1_language_id


def grams(text: str) -> Counter:
    """Plain counts; a gram is a tuple of code points, 1 for a word's edge."""
    out = Counter()
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split(" ")
    for w in filter(None, words):
        p = (1, *map(ord, w), 1)
        out.update((c,) for c in p[1:-1])
        out.update(zip(p, p[1:], strict=False))
        out.update(zip(p, p[1:], p[2:], strict=False))
    return out



def order(gram: tuple) -> int:
    code = 0
    for c in gram:
        code = code << 21 | c
    return code


def top(counts: Counter) -> list[tuple]:
    return sorted(counts, key=lambda g: (-counts[g], order(g)))[: language_id.PROFILE_SIZE]


def test_query_is_the_plain_method(spark, sf_dir, table):
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 4 == 2
    learned = defaultdict(Counter)
    for k, text, lang, _ in table.itertuples(index=False):
        if k is not None and not held(k) and text is not None and lang is not None:
            learned[lang] += grams(text)
    profiles = {lang: {g: i for i, g in enumerate(top(c))} for lang, c in learned.items()}
    want = []
    for k, text, _, _ in table.itertuples(index=False):
        own = top(grams(text or ""))
        if not own:
            want.append((k, held(k), "und", 0.0))
            continue
        n = language_id.PROFILE_SIZE
        far = {lang: sum(min(abs(p[g] - i), n) if g in p else n for i, g in enumerate(own)) for lang, p in sorted(profiles.items())}
        best = min(far, key=far.get)
        want.append((k, held(k), best, round(1 - far[best] / (n * len(own)), 9)))
    got = [(r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 9)) for r in op1_language_id(spark, sf_dir).collect()]
    text = lambda rows: sorted(map(str, rows))
    assert text(got) == text(want)


def test_held_out_documents_are_told_apart(spark, sf_dir, table):
    lang = {k: x for k, x, y in zip(table.doc_id, table.lang, table.index, strict=True) if y < 120}
    found = [(r["lang_pred"], lang[r["doc_id"]]) for r in op1_language_id(spark, sf_dir).where("held_out").collect() if r["doc_id"] in lang]
    assert len(found) > 10 and sum(a == b for a, b in found) / len(found) >= 0.95


def test_no_profiles_and_no_rows(spark, empty_dir, docs):
    assert op1_language_id(spark, empty_dir).count() == 0
    found = language_id.identify(docs, language_id.build_profiles(docs.limit(0)))
    assert {r["lang_pred"] for r in found.collect()} == {"und"}
    assert found.columns == [c for c in docs.columns if c not in ("lang_pred", "score")] + ["lang_pred", "score"]


def test_a_language_for_each_row_is_refused(spark, monkeypatch):
    rows = spark.range(20).selectExpr("id AS doc_id", "'some text' AS text", "cast(id AS string) AS lang")
    assert language_id.build_profiles(rows).count() > 0
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 10)
    with pytest.raises(ValueError, match="different languages"):
        language_id.build_profiles(rows)


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 1 << 20])
def test_pieces_of_a_text_count_as_the_whole(monkeypatch, piece):
    monkeypatch.setattr(language_id, "PIECE", piece)
    for text in ("", "a", " ", "ab", "12 ab  c!!d ", "Ünï ΌΔΟΣ ΣΑΣ漢字 x", "a" * 9, "... a ...", "\U0001f600e\U0001f600", "the cat sat. " * 5):
        codes, counts = language_id.gram_counts(text)
        assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == {order(g): n for g, n in grams(text).items()}
        assert codes.tolist() == sorted(codes.tolist())


def test_memory_does_not_follow_the_length_of_a_text():
    import tracemalloc

    text = "the cat sat on the mat. " * 500_000  # 12 MB
    tracemalloc.start()
    language_id.gram_counts(text)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 150 << 20
