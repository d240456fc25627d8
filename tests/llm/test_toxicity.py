from __future__ import annotations

import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest

from assay.llm import toxicity
from assay.llm.queries import op5_toxicity
from tests.llm.conftest import prose

TABLES = Path("/root/testdata/sf0.1")


def ranked(score: np.ndarray, toxic: np.ndarray) -> float:
    """The share of (toxic, clean) pairs that scores order rightly, by all pairs."""
    d = score[toxic == 1][:, None] - score[toxic == 0][None, :]
    return float(((d > 0) + 0.5 * (d == 0)).mean())


def test_query_covers_every_row(spark, sf_dir, empty_dir, table):
    got = op5_toxicity(spark, sf_dir).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(map(str, table.doc_id))
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    assert op5_toxicity(spark, empty_dir).count() == 0


def test_held_out_rows_of_a_planted_vocabulary(spark):
    rng, rows = random.Random(7), []
    for i in range(1_200):
        toxic = int(i % 8 == 0)
        words = prose(rng, "en", 60).split()
        if toxic:
            for w in rng.sample(["grubwort", "snarlpox", "foulmug", "idiot", "scum", "grubworts"], 3):
                words.insert(rng.randrange(60), w)
        rows.append((i, " ".join(words), toxic))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.where("doc_id % 3 <> 1"))
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.score(df.drop("toxic"), model).collect()}
    held = [r for r in rows if r[0] % 3 == 1]
    assert ranked(np.array([got[r[0]][0] for r in held]), np.array([r[2] for r in held])) >= 0.97
    assert np.mean([got[r[0]][1] == r[2] for r in held]) >= 0.97


def test_label_model_finds_good_voters_and_discounts_copies():
    rng = np.random.default_rng(5)
    y = rng.random(4_000) < 0.2
    vote = lambda hit, false: np.where(y, rng.random(4_000) < hit, rng.random(4_000) < false)
    good = [vote(0.6, 0.01) for _ in range(4)]
    noise = vote(0.1, 0.1)
    model = toxicity.LabelModel(0.2)
    post = model.fit(np.stack([*good, noise, noise], axis=1))
    assert ((post > 0.5) == y).mean() > 0.95
    ratio = model.rates[1] / model.rates[0]
    assert ratio[:4].min() > 5 * ratio[4]
    assert model.correlations[4, 5] > 0.9 and abs(model.correlations[0, 1]) < 0.3


def test_posterior_is_bayes_rule_over_the_forest():
    """Against a plain product of probabilities, row by row; a voter that copies another is found to depend on it."""
    rng = np.random.default_rng(2)
    y = rng.random(3_000) < 0.3
    a, b, d, e = (np.where(y, rng.random(3_000) < hit, rng.random(3_000) < false) for hit, false in ((0.7, 0.05), (0.6, 0.02), (0.6, 0.03), (0.7, 0.02)))
    c = np.where(rng.random(3_000) < 0.9, a, rng.random(3_000) < 0.3)  # mostly what a says
    votes = np.stack([a, b, c, d, e], axis=1)
    model = toxicity.LabelModel(0.3)
    post = model.fit(votes)
    assert {frozenset((j, int(p))) for j, p in enumerate(model.parents) if p >= 0} == {frozenset((0, 2))}
    for row, got in zip(votes[:200].tolist(), post[:200].tolist(), strict=True):
        joint = [0.7, 0.3]
        for k in (0, 1):
            for j, v in enumerate(row):
                p = model.given[k, int(row[model.parents[j]]) if model.parents[j] >= 0 else 0, j]
                joint[k] *= p if v else 1 - p
        assert abs(joint[1] / sum(joint) - got) < 1e-4
    assert ((post > 0.5) == y).mean() > 0.9


def test_scores_are_those_of_a_plain_sum(spark, docs):
    """Every text's score, by looking for each feature by itself."""
    rng = random.Random(3)
    texts = [prose(rng, "en", 20) + (f" scum snarlpox{'es' if i % 10 else ''}" if i % 5 == 0 else "") for i in range(400)]
    rows = spark.createDataFrame([(i, t, int(i % 5 == 0)) for i, t in enumerate(texts)], "doc_id long, text string, toxic int")
    model = toxicity.train(rows)
    assert any(n.startswith("snar") for n in model.names) and model.report()
    given = docs.select("doc_id", "text").unionByName(rows.select("doc_id", "text").limit(40))
    for r in toxicity.score(given, model).collect():
        text, total = r["text"] or "", model.bias
        words = {w.lower() for w in re.findall(r"[^\W\d_]+", text)}
        for name, weight in zip(model.names, model.weights, strict=True):
            kind, _, rest = name.partition(":")
            if kind == "lexicon":
                hit = any(w in words for w in toxicity.LEXICONS[rest])
            elif kind == "pattern":
                hit = re.search(toxicity.PATTERNS[rest], text) is not None
            elif "-" in name:
                stem, _, times = name.partition("-")
                hit = sum(w.startswith(stem) and len(w) > len(stem) for w in words) >= int(times or 1)
            else:
                hit = name in words
            total += weight * hit
        assert abs(r["score"] - 1 / (1 + np.exp(-np.clip(total, -40, 40)))) < 1e-9, r


def test_no_labels_leave_the_written_voters(spark):
    model = toxicity.train(spark.createDataFrame([], "doc_id long, text string, toxic int"))
    rows = spark.createDataFrame([(1, "you are an idiot and scum"), (2, "good day"), (3, None), (4, "")], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in toxicity.score(rows, model).collect()}
    assert score[1] > 0.7 > score[2] == score[3] == score[4]


@pytest.mark.skipif(not TABLES.exists(), reason="needs the driver's tables")
def test_held_out_rows_of_the_tables(spark):
    got = op5_toxicity(spark, str(TABLES)).join(spark.read.parquet(f"{TABLES}/labels.parquet"), "doc_id").where("held_out AND toxic IS NOT NULL").select("score", "toxic", "predicted").toPandas()
    assert ranked(got["score"].to_numpy(), got["toxic"].to_numpy()) >= 0.9
    flagged = got[got.predicted == 1]
    assert (flagged.toxic == 1).mean() >= 0.9
