"""op12 against a covariance that is built whole, and whole-number sums."""

from __future__ import annotations

import math

import numpy as np
import pytest

from assay.llm import embedding_whitening as W
from assay.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, x int, n string"


def plain(vectors: list[tuple[int | None, list]]) -> tuple[list, np.ndarray, np.ndarray, float, list[int]]:
    good = [(k, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]) for k, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, d = len(good), len(good[0][1])
    sums = [sum(x[j] for _, x in good) for j in range(d)]
    off = np.array([[(n * x[j] - sums[j]) / n for j in range(d)] for _, x in good])
    values, vectors_ = np.linalg.eigh(off.T @ off / n)
    deviation = [sum((n * x[j] - sums[j]) ** 2 for j in range(d)) for _, x in good]
    return [k for k, _ in good], values[::-1], off @ vectors_[:, ::-1], float((off**2).sum() / n), deviation


def rows(kind: str, n: int = 400, d: int = 40) -> list[tuple]:
    rng = np.random.default_rng(7)
    scale = {"falling": 0.5 ** np.arange(d), "flat": np.ones(d), "narrow": np.ones(d)}[kind]
    if kind == "narrow":
        d, scale = 5, np.arange(5, 0, -1)
    turned = np.linalg.qr(rng.standard_normal((d, d)))[0]
    found = [(i, v) for i, v in enumerate(((rng.standard_normal((n, d)) * scale) @ turned + 0.3).tolist())]
    found += [(found[0][0], found[0][1]), (None, found[1][1]), (900, None), (901, [None] + [0.1] * (d - 1)), (902, [math.nan] * d), (903, [math.inf] + [0.0] * (d - 1)), (904, []), (905, [1.0])]
    return [(k, v, 1, 2, "n") for k, v in found]


@pytest.mark.parametrize("kind, expanded", [("falling", False), ("flat", True), ("narrow", False)])
def test_against_the_whole_covariance(spark, kind, expanded):
    data = rows(kind)
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    keys, values, on, trace, deviation = plain([(k, v) for k, v, *_ in data if k not in (904, 905)])
    got = W.whiten(df).collect()
    k = min(8, on.shape[1])
    assert len(got) == len(keys) * k
    assert W.fit(W.rows_of(df)).expanded == expanded
    assert {r["n"] for r in got} == {len(keys)}
    assert sorted((str(r["vec_id"]), r["deviation"]) for r in got if r["component"] == 1) == sorted((str(x), y) for x, y in zip(keys, deviation, strict=True))
    once = {x: i for i, x in enumerate(keys) if keys.count(x) == 1}
    for c in range(1, k + 1):
        mine = {r["vec_id"]: r for r in got if r["component"] == c and r["vec_id"] in once}
        want = {x: on[i, c - 1] / math.sqrt(values[c - 1]) for x, i in once.items()}
        sign = math.copysign(1, sum(mine[x]["whitened"] * want[x] for x in want))
        assert max(abs(sign * mine[x]["whitened"] - want[x]) for x in want) < 1e-7
        assert all(abs(r["explained"] * trace / values[c - 1] - 1) < 1e-9 for r in mine.values())
    errors = {r["identity_error"] for r in got}
    assert len(errors) == 1 and 0 <= errors.pop() < 1e-9


def test_dimensions_without_spread_are_left_out(spark):
    df = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0], 0, 0, "") for i in range(9)], SCHEMA)
    assert {r["component"] for r in W.whiten(df).collect()} == {1}
    for same in ([(1, [0.5, 0.25], 0, 0, "")], [(i, [0.5, 0.25], 0, 0, "") for i in range(5)]):
        assert W.whiten(spark.createDataFrame(same, SCHEMA)).collect() == []


def test_large_entries_stay_exact(spark):
    data = [(1, [1e9, 0.0]), (2, [-1e9, 3.0]), (3, [5e8, 1e20])]
    got = W.whiten(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in data[:2]]
    want = sum((2 * x[0][j] - x[0][j] - x[1][j]) ** 2 for j in range(2))
    assert {r["vec_id"]: r["deviation"] for r in got} == {1: want if want < 1 << 63 else None, 2: want if want < 1 << 63 else None}
    fit = W.Fit(10, [3 * (1 << 40)] * 2, np.zeros(0), np.zeros((2, 0)), 0.0)
    assert fit.deviation(np.array([[1 << 45, 0], [(3 << 40) // 10, (3 << 40) // 10]])) == [None, sum((10 * ((3 << 40) // 10) - (3 << 40)) ** 2 for _ in range(2))]


def test_wide_vectors_go_by_panels(spark, monkeypatch):
    monkeypatch.setattr(W, "PANEL", 7)
    df = spark.createDataFrame(rows("flat"), SCHEMA)
    assert W.fit(W.rows_of(df)).identity_error < 1e-9


def test_empty_table(spark, empty_dir):
    assert QUERIES["op12_embedding_whitening"](spark, empty_dir).collect() == []


def test_whole_table(spark):
    import pyarrow.parquet as pq

    at = "/root/testdata/sf0.001"
    got = QUERIES["op12_embedding_whitening"](spark, at).toPandas()
    data = pq.read_table(f"{at}/embeddings.parquet", columns=["vec_id", "embedding"]).to_pylist()
    keys, values, on, trace, deviation = plain([(r["vec_id"], r["embedding"]) for r in data])
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[keys].to_numpy()
    want = on[:, :8] / np.sqrt(values[:8])
    assert np.abs(table * np.sign((table * want).sum(axis=0)) - want).max() < 1e-7
    assert got.drop_duplicates("vec_id").set_index("vec_id")["deviation"].loc[keys].tolist() == deviation
    assert np.abs(got.drop_duplicates("component").sort_values("component")["explained"] - values[:8] / trace).max() < 1e-12
