from __future__ import annotations

import random
import re

import xxhash

from assay.llm import simhash
from assay.llm.common import components
from assay.llm.queries import op3_simhash


def plain(text: str) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, linked) -> dict:
    """The least node that each reaches, by all pairs."""
    at = {n: n for n in nodes}

    def find(n):
        while at[n] != n:
            n = at[n]
        return n

    order = sorted(at)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                at[y] = x
    return {n: find(n) for n in at}


def near(a: int, b: int) -> bool:
    return (a ^ b).bit_count() <= 2


def test_query_is_all_pairs(spark, sf_dir, table):
    prints = [plain(t or "") for t in table.text]
    root = roots(set(prints), near)
    least = {}
    for k, fp in zip(table.doc_id, prints, strict=True):
        if k is not None:
            least[root[fp]] = min(k, least.get(root[fp], k))
    want = [(k, f"{fp:016x}", least.get(root[fp])) for k, fp in zip(table.doc_id, prints, strict=True)]
    got = [tuple(r) for r in op3_simhash(spark, sf_dir).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_links_of_crowded_buckets_lose_no_component(spark):
    rng = random.Random(3)
    low = rng.getrandbits(32)
    prints = {0, 3, (1 << 64) - 1} | {rng.getrandbits(64) for _ in range(50)}
    for _ in range(150):  # one segment shared by many; chains of one and two bits
        p = rng.choice([rng.getrandbits(32) << 32 | low, rng.choice(sorted(prints))])
        prints |= {p, p ^ 1 << rng.randrange(64), p ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64)}
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    want = roots({signed(p) for p in prints}, lambda a, b: near(a & (1 << 64) - 1, b & (1 << 64) - 1))
    for bucket in (1, 4, 64):
        found = {r["node"]: r["root"] for r in components(simhash.links(df, bucket)).collect()}
        assert {p: found.get(p, p) for p in want} == want


def words5(text: str) -> set[str]:
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_one_document_of_each_group_stays(spark, docs, table, empty_dir):
    """Groups by all pairs: fingerprints within two bits, or sets of five-word shingles at a similarity of 0.8."""
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    texts = sorted({(k, t or "") for k, t in zip(table.doc_id, table.text, strict=True)}, key=lambda x: (x[0] is None, x[0] or 0))
    prints, sets = [plain(t) for _, t in texts], [words5(t) for _, t in texts]
    root = roots(range(len(texts)), lambda i, j: near(prints[i], prints[j]) or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))
    assert sorted(str(r["doc_id"]) for r in kept.select("doc_id").collect()) == sorted(str(texts[i][0]) for i in set(root.values()))
    assert op3_simhash(spark, empty_dir).count() == 0
    assert simhash.keep_one(docs.limit(0)).count() == 0
