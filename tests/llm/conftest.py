"""A small documents table with the awkward rows: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

import pandas as pd
import pytest

SYLLABLES = {"en": "the ing tion ou ea th st ly".split(), "de": "sch ein ung ich der au cht ß".split(), "es": "ción que ado los ña ie rr os".split(), "fr": "eau ment oi qu é ais tre eux".split()}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, _row string, _cell int, n_lines int, rank int, shard int, size int, _kept long, fp long"


def prose(rng: random.Random, lang: str, words: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(words))


def rows() -> list[tuple]:
    rng, out = random.Random(1), []
    add = lambda text, lang="en", source="web", key=...: out.append((len(out) if key is ... else key, text, lang, source))
    for _ in range(30):
        for lang in SYLLABLES:
            add(prose(rng, lang, rng.randint(30, 120)), lang, rng.choice(["web", "web", "book", None]))
    base = prose(rng, "en", 300)
    for _ in range(12):
        add(base)
    for i in range(6):
        words = base.split()
        words[10 * i] = "changed"
        add(" ".join(words))
    for text in (None, "", " \t\n", "12345 !?", "Ünïcode ☃ 漢字 \U0001f600 ▁ x", "a", "a b", "\x01\x02\x03 token=abcdef", "\n\n\n\n\n\n", "Word\r\nWord\x0bWord"):
        add(text, None if text is None else "en", None)
        add(text, "de")
    passage = "\n".join(prose(rng, "fr", 20) for _ in range(4))
    for _ in range(5):
        add(prose(rng, "fr", 25) + "\n" + passage + "\n" + prose(rng, "fr", 25), "fr")
    key = "AKIA" + "Z9" * 9
    add(f'my Password = "hunter2hunter2" and {key} or {"0f" * 14} end', "en")
    add("api_key:short secret=abc token='x/y+z=longer' passwd:" + "q" * 50, "en")
    add(" ".join(["token=abcdefg"] * 40), "en")
    add(prose(rng, "es", 9_000), "es")
    add("zz " * 5_000, "en")
    add(prose(rng, "de", 60), None, "web", None)
    out.append(out[5])  # a repeated row
    return [(k, t, lang, source, None if t is None else len(t), 0.5, "xx", "row", 1, 2, 3, 4, 5, 6, 7) for k, t, lang, source in out]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def sf_dir(spark, docs, tmp_path_factory) -> str:
    at = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(0, 120, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory) -> str:
    at = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return at


@pytest.fixture(scope="session")
def table() -> pd.DataFrame:
    return pd.DataFrame([r[:4] for r in rows()], columns=["doc_id", "text", "lang", "source"], dtype=object)
