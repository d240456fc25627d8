from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

from assay.llm import sharding
from assay.llm.common import group_rank
from assay.llm.queries import op7_sharding


def test_query_is_gapless_even_and_mixed(spark, sf_dir, table):
    got = op7_sharding(spark, sf_dir).collect()
    body = lambda t: (t or "").encode()
    want = sorted((str(k), len(body(t)) + 16, zlib.crc32(body(t))) for k, t in zip(table.doc_id, table.text, strict=True))
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    shards = defaultdict(list)
    for r in got:
        assert r["law"] == "rows" and r["grown_shard"] is None
        shards[r["shard"]].append(r["slot"])
    assert set(shards) == set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1


def test_places_are_those_of_a_plain_interleaving(spark, sf_dir, table):
    """Every row's shard and slot, by sorting each source by its draw and all rows by fractional rank."""
    rows = []
    for k, t, source in zip(table.doc_id, table.text, table.source, strict=True):
        body = (t or "").encode()
        named = [sharding.SEED, *([] if k is None else [str(k)]), str(len(body) + 16), str(zlib.crc32(body))]
        rows.append((hashlib.md5(":".join(named).encode()).hexdigest(), k, zlib.crc32(body), source))
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[3]].append(r)
    placed = []
    for source, own in by_source.items():
        u = int(hashlib.md5(f"{sharding.SEED}:{'null' if source is None else f'of:{source}'}".encode()).hexdigest()[:13], 16) / 2**52
        for i, r in enumerate(sorted(own, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))):
            placed.append(((i + u) / len(own), source is not None, source or "", r[0], r[1] is not None, r[1] or 0, r[2]))
    n = len(placed)
    want, first = [], {}
    for p, (*_, has_key, key, checksum) in enumerate(sorted(placed)):
        shard = p * 40 // n
        want.append((str(key if has_key else None), checksum, shard, p - first.setdefault(shard, p)))
    got = [(str(r["doc_id"]), r["text_crc32"], r["shard"], r["slot"]) for r in op7_sharding(spark, sf_dir).collect()]
    assert sorted(got) == sorted(want)


def test_very_often_repeated_rows_fall_into_many_cells(spark, monkeypatch):
    rows = spark.range(3_000).selectExpr("CASE WHEN id % 2 = 0 THEN id END AS doc_id", "CASE WHEN id % 2 = 0 THEN cast(id AS string) END AS text", "'s' AS source")
    numbered = sharding._numbered(sharding.describe(rows).repartition(4), often=200)
    assert numbered.where("doc_id IS NOT NULL AND _copy IS NOT NULL").count() == 0
    assert numbered.where("doc_id IS NULL").select("_copy").distinct().count() > 10
    monkeypatch.setattr(sharding, "spread", lambda n: 15)
    monkeypatch.setattr(sharding._numbered, "__defaults__", (200,))
    slots = defaultdict(list)
    for r in sharding.interleave(sharding.describe(rows), 10).collect():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(300)) for x in slots.values()) and len(slots) == 10


def test_every_stretch_carries_each_source_at_its_share(spark, monkeypatch):
    rows = spark.range(6_000).selectExpr("id AS doc_id", "cast(id AS string) AS text", "CASE WHEN id % 6 < 3 THEN 'hot' WHEN id % 6 < 5 THEN 'mid' END AS source")
    for per_cell in (50_000, 700):  # one cell, and many
        monkeypatch.setattr(sharding, "spread", lambda n, per_cell=per_cell: -(-n // per_cell))
        found = sharding.interleave(sharding.describe(rows), 10).collect()
        mix = Counter((r["shard"], r["source"]) for r in found)
        for s in range(10):
            assert abs(mix[s, "hot"] - 300) <= 2 and abs(mix[s, "mid"] - 200) <= 2 and abs(mix[s, None] - 100) <= 2
        slots = defaultdict(list)
        for r in found:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(x) == list(range(600)) for x in slots.values())


def test_many_small_sources_are_spread_over_all_shards(spark, monkeypatch):
    """2,000 sources of one row and one of 2,000: each shard has its share of both, and no band holds them all."""
    rows = spark.range(4_000).selectExpr("id AS doc_id", "cast(id AS string) AS text", "CASE WHEN id % 2 = 0 THEN 'large' ELSE concat('host', id) END AS source")
    monkeypatch.setattr(sharding, "spread", lambda n: 8)
    described = sharding.describe(rows)
    mix = Counter((r["shard"], r["source"] == "large") for r in sharding.interleave(described, 10).collect())
    assert all(abs(mix[s, False] - 200) <= 3 * 13.5 and mix[s, True] == 400 - mix[s, False] for s in range(10))
    bands = Counter(int(r["at"] * 8) for r in described.where("source != 'large'").select(sharding.phase(sharding.SEED).alias("at")).collect())
    assert max(bands.values()) < 2 * 250


def test_ranks_do_not_depend_on_cells(spark):
    rows = spark.range(500).selectExpr("id", "CASE WHEN id < 400 THEN 'a' WHEN id < 450 THEN 'b' END AS g")
    for cells in (1, 7):
        found = group_rank(rows, "g", ["id"], cells).collect()
        ranks = defaultdict(list)
        for r in found:
            ranks[r["g"]].append(r["rank"])
            assert r["rank_of"] == {"a": 400, "b": 50, None: 50}[r["g"]]
        assert all(sorted(x) == list(range(len(x))) for x in ranks.values())


def test_same_seed_same_shards_no_python_and_few_rows(spark, sf_dir, empty_dir):
    place = lambda: sorted(map(str, (tuple(r) for r in op7_sharding(spark, sf_dir).collect())))
    assert place() == place()
    plan = op7_sharding(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert op7_sharding(spark, empty_dir).count() == 0
    few = spark.createDataFrame([(1, None, None), (1, None, None), (None, "x", "s")], "doc_id long, text string, source string")
    assert sorted(r["slot"] for r in sharding.interleave(sharding.describe(few), 5).collect()) == [0, 0, 0]
