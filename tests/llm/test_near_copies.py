from __future__ import annotations

import random

import corpus_pipeline
from assay.llm import near_copies, simhash
from tests.llm.conftest import prose
from tests.llm.test_simhash import near, plain, roots


def plain_set(text: str) -> set[str]:
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def alike(a: set, b: set) -> bool:
    return 5 * len(a & b) >= 4 * len(a | b)


def changed(rng: random.Random, text: str, n: int) -> str:
    words = text.split()
    for i in rng.sample(range(len(words)), n):
        words[i] = f"x{rng.randrange(1 << 30)}"
    return " ".join(words)


def made(rng: random.Random) -> list[str]:
    texts = []
    for _ in range(40):  # pairs around the bound
        base = prose(rng, "en", rng.randint(60, 200))
        texts += [base, changed(rng, base, len(base.split()) * rng.randint(0, 6) // 100)]
    base = prose(rng, "de", 150)
    return texts + [changed(rng, base, 2).title() for _ in range(60)] + [base]  # one large group


def test_stage_finds_all_pairs(spark):
    rng = random.Random(6)
    texts = made(rng)
    rng.shuffle(texts)
    sets, prints = [plain_set(t) for t in texts], [plain(t) for t in texts]
    root = roots(range(len(texts)), lambda i, j: near(prints[i], prints[j]) or alike(sets[i], sets[j]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, "").collect())
    assert got == sorted(set(root.values()))
    by_bits = roots(range(len(texts)), lambda i, j: near(prints[i], prints[j]))
    assert len(got) < len(set(by_bits.values()))


def test_links_are_near_copies_only(spark):
    texts = made(random.Random(7))
    sets = {plain(t): plain_set(t) for t in texts}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    distinct = near_copies.distinct_texts(near_copies.marks(df))
    hits = near_copies.shared_bands(distinct)
    found = near_copies.links(hits, near_copies.shingle_sets(df, distinct, hits)).collect()
    assert found and all(alike(sets[r["a"] % (1 << 64)], sets[r["b"] % (1 << 64)]) for r in found)
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_no_link_of_a_crowded_band_is_lost(spark, monkeypatch):
    """Many texts about one passage: most are too far apart, some pairs are alike, and no text is like all."""
    rng = random.Random(11)
    passage = prose(rng, "en", 150)
    texts = []
    for _ in range(120):
        base = passage + " " + prose(rng, "en", 30)
        texts.append(base)
        if rng.random() < 0.4:
            texts.append(changed(rng, base, 2))
    rng.shuffle(texts)
    sets = [plain_set(t) for t in texts]
    root = roots(range(len(texts)), lambda i, j: alike(sets[i], sets[j]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    marked = near_copies.marks(df).cache()
    hits = near_copies.shared_bands(near_copies.distinct_texts(marked))
    assert hits.where("entries > 16").count() > 0
    alone = spark.createDataFrame([], "a long, b long")
    at = {r["place"]["key"]: r["fp"] for r in marked.collect()}
    for bucket, shingles in ((16, near_copies.TILE_SHINGLES), (4, 5_000)):  # one tile, then tiles of about 25 texts
        monkeypatch.setattr(near_copies, "TILE_SHINGLES", shingles)
        by = {r["node"]: r["root"] for r in near_copies.joined(df, marked, alone, bucket=bucket).collect()}
        mine = {i: by.get(fp, fp) for i, fp in at.items()}
        assert len(set(mine.values())) == len(set(root.values()))
        assert all((mine[i] == mine[j]) == (root[i] == root[j]) for i in mine for j in mine)
