from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from assay.llm import embedding_dedup as ed
from assay.llm.queries import op9_embedding_dedup
from tests.llm.test_simhash import roots

SCHEMA = "vec_id long, embedding array<float>, label int, n long, caps int"


def vectors() -> list[tuple]:
    rng, rows = np.random.default_rng(8), []
    for label in (0, 1, None):
        for _ in range(60):
            rows.append((rng.standard_normal(24), label))
        center = rng.standard_normal(24)
        for _ in range(90):  # a hot group around the bound
            rows.append((center + rng.standard_normal(24) * 0.27, label))
        rows += [(center, label)] * 5
    out = [(i, [float(np.float32(x)) for x in v], label, 1, 2) for i, (v, label) in enumerate(rows)]
    n = len(out)
    odd = [None, [0.0] * 24, [1.0] * 23 + [math.nan], [1.0] * 23 + [math.inf], [1.0] * 23 + [None], [], [2.0], [3.0], [-0.0, 5.0]]
    return out + [(n + i, v, 0, 1, 2) for i, v in enumerate(odd)]


def links(rows: list[tuple]) -> set[tuple[int, int]]:
    usable = [(k, np.array(v, float), label) for k, v, label, *_ in rows if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = set()
    for i, (a, x, p) in enumerate(usable):
        for b, y, q in usable[i + 1 :]:
            if p == q and len(x) == len(y) and (x * y).sum() / (math.sqrt((x * x).sum()) * math.sqrt((y * y).sum())) >= 0.93:
                out |= {(a, b), (b, a)}
    return out


@pytest.fixture(scope="module")
def at(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("vectors"))
    spark.createDataFrame(vectors(), SCHEMA).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return path


def test_query_is_nearly_all_pairs_and_links_nothing_else(spark, at):
    rows = vectors()
    true = links(rows)
    got = {r["vec_id"]: r for r in op9_embedding_dedup(spark, at).collect()}
    assert sorted(got) == [r[0] for r in rows]
    degree = {k: 0 for k in got}
    for a, _ in true:
        degree[a] += 1
    assert len(true) > 2_000
    assert all(got[k]["n_links"] <= degree[k] for k in got)
    assert sum(r["n_links"] for r in got.values()) / len(true) >= 0.97
    root = roots(list(got), lambda a, b: (a, b) in true)
    assert np.mean([got[k]["component_id"] == root[k] for k in got]) >= 0.97
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_repeated_and_null_ids_are_vectors_of_their_own(spark):
    """Every row by comparing it with all others."""
    rng = np.random.default_rng(11)
    base = rng.standard_normal((4, 32))
    near = [(b + 0.02 * rng.standard_normal(32)).tolist() for b in base for _ in range(4)]
    ids = [1, 1, 2, None] + [None, None, None, None] + [9, 8, 8, 7] + [None, 20, 21, 20]
    rows = list(zip(ids, near, [0] * 16, strict=True)) + [(1, near[0], 0), (None, near[4], 0), (5, near[0], 1), (5, near[0], None), (6, [0.0] * 32, 0), (None, [None] + near[0][1:], 0), (30, near[0][1:], 0), (31, near[0][1:] + [None], 0), (32, [-0.0 if x == 0 else x for x in near[8]], 0)]
    good = [lab is not None and all(x is not None for x in v) and any(v) for _, v, lab in rows]
    unit = [np.array(v) / np.linalg.norm(v) if g else None for (_, v, _), g in zip(rows, good, strict=True)]
    linked = lambda i, j: i != j and good[i] and good[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and unit[i] @ unit[j] >= 0.93
    reach = [{i} | {j for j in range(len(rows)) if linked(i, j)} for i in range(len(rows))]
    for _ in rows:
        reach = [set().union(*(reach[j] for j in own)) for own in reach]
    want = []
    for i, (key, _, _) in enumerate(rows):
        least = min((rows[j][0] for j in reach[i] if rows[j][0] is not None), default=None)
        want.append((key, sum(linked(i, j) for j in range(len(rows))), least, key is not None and key == least))
    got = ed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3))
    assert sorted(map(tuple, got.select("vec_id", "n_links", "component_id", "kept").collect()), key=str) == sorted(want, key=str)


def test_small_tiles_find_the_same(spark, at):
    df = spark.read.parquet(f"{at}/embeddings.parquet")
    read = lambda tile: sorted(map(tuple, ed.near_duplicates(df, tile=tile).collect()))
    assert read(16) == read(1_024)


def test_decoding_lists_exactly_the_caps():
    caps, x = ed.Caps(dim=10, bar=0.5, parts=2, words=6, turns=3), np.random.default_rng(1).standard_normal((40, 10))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    row, cap = caps.decode(unit)
    want = set()
    for turn, (rotation, (first, second)) in enumerate(caps.codes()):
        for i in range(6):
            for j in range(6):
                direction = np.concatenate((first[i], second[j]))
                hit = unit @ rotation @ direction >= 0.5 * math.sqrt(2)
                want |= {(int(r), (turn * 6 + i) * 6 + j) for r in np.flatnonzero(hit)}
    assert set(zip(row.tolist(), cap.tolist(), strict=True)) == want


@pytest.mark.parametrize("dim", [1, 2, 4, 8, 12, 24, 64, 300])
@pytest.mark.parametrize("members", [10, 5_000, 1_000_000])
def test_filters_find_pairs_at_the_bound_and_hold_few_others(dim, members):
    caps = ed.fit_caps(members, dim)
    rng = np.random.default_rng(3)
    x, y = rng.standard_normal((2, 400, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = x if dim == 1 else 0.931 * x + math.sqrt(1 - 0.931**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    mine, other = (set(zip(*map(np.ndarray.tolist, caps.decode(v)), strict=True)) for v in (x, y))
    assert len({r for r, _ in mine & other}) >= 0.975 * 400
    per_vector = len(mine) / 400
    if dim >= 24:  # unrelated vectors that a vector is compared with, all caps together: no more for a thousand times the rows
        z = rng.standard_normal((400, dim))
        apart = set(zip(*map(np.ndarray.tolist, caps.decode(z / np.linalg.norm(z, axis=1, keepdims=True))), strict=True))
        by_cap = Counter(c for _, c in mine)
        met = sum(by_cap[c] for _, c in apart) / 400 / 400 * members
        assert per_vector < 150 and met < 1_000


def test_empty_table(spark, empty_dir):
    assert op9_embedding_dedup(spark, empty_dir).count() == 0
