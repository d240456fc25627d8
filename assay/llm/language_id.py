"""Language ID by rank-order profiles.

A language's profile is the list of its most frequent 1- to 3-character grams, most
frequent first; a document is compared to each profile by the out-of-place distance:
for each of the document's most frequent grams, how far its rank is from its rank in
the profile, or the whole profile length where the profile lacks it.

Grams are taken within words: letters are lower-cased, every run of other characters
is one word boundary, written as a space.  Ties of frequency are broken by code point.

A long text is counted in pieces, so that memory does not follow its length.

Defined cases: a text that is null or has no letter is `und` with score 0; equal
distances go to the language that sorts first; with no profiles all is `und`; extra
columns, repeated rows and null keys pass through untouched.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assay.llm.common import has_columns, materialize

UNKNOWN = "und"
PROFILE_SIZE = 400
#: The profiles learn from about this many documents of each language, chosen by a hash of their key.
ROWS_PER_LANGUAGE = 2_000
#: Profiles are broadcast: a table with more values of lang than this is refused.
MOST_LANGUAGES = 10_000
#: Characters of a text that are counted together.
PIECE = 1 << 20
_EDGE = 1  # stands for a word boundary in gram codes; not a letter


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Gram codes (21 bits a character) and their counts, by code; of a long text piece by piece."""
    text = text.lower()  # as a whole: how a sigma is written depends on what follows
    codes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    before = np.array([_EDGE])  # the last two characters of the pieces so far, edges in a row as one
    for i in range(0, len(text), PIECE):
        points = np.frombuffer(text[i : i + PIECE].encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        points = np.where(_letters()[points], points, _EDGE)
        if i + PIECE >= len(text):
            points = np.append(points, _EDGE)
        first = len(before)
        points = np.concatenate((before, points))
        points = points[np.concatenate((np.ones(first, bool), (points[first:] != _EDGE) | (points[first - 1 : -1] != _EDGE)))]
        two = points[:-1] << 21 | points[1:]
        three = (two[:-1] << 21 | points[2:])[points[1:-1] != _EDGE]
        if first == 2:  # the first of both was counted with the piece before
            two = two[1:]
        one = points[first:]
        found, n = np.unique(np.concatenate((one[one != _EDGE], two, three)), return_counts=True)
        if len(codes):
            found, at = np.unique(np.concatenate((codes, found)), return_inverse=True)
            n = np.bincount(at, np.concatenate((counts, n)), len(found)).astype(np.int64)
        codes, counts, before = found, n, points[-2:]
    return codes, counts


def gram_text(code: int) -> str:
    out = ""
    while code:
        out = (" " if code & 0x1FFFFF == _EDGE else chr(code & 0x1FFFFF)) + out
        code >>= 21
    return out


def _top(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    return codes[np.argsort(-counts, kind="stable")[:size]]


def build_profiles(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", size: int = PROFILE_SIZE, rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """profiles(lang, code, rank) from labelled rows (gram_text() reads a code); rows without text or language teach nothing."""
    has_columns(labelled, key, text, lang)
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    sizes = materialize(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")))
    if sizes.count() > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} different languages: {lang} does not name languages")
    share = F.pmod(F.xxhash64(F.lit("profile"), F.coalesce("key", F.lit(""))), F.lit(1_000_000)) < F.lit(1_000_000.0 * rows_per_language) / F.col("rows")
    chosen = rows.join(F.broadcast(sizes), "lang").where(share)  # MOST_LANGUAGES rows at most

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, group in batch.groupby("lang"):
                found = [gram_counts(t) for t in group["text"]]
                codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                yield pd.DataFrame({"lang": name, "code": codes, "n": np.bincount(at, np.concatenate([n for _, n in found]), len(codes)).astype(np.int64)})

    counted = chosen.select("lang", "text").mapInPandas(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code")) - 1
    return counted.withColumn("rank", rank).where(F.col("rank") < size).select("lang", "code", "rank")


class Profiles:
    """The profiles as arrays, languages in alphabetical order; bounded by languages x profile size."""

    def __init__(self, rows: list, size: int = PROFILE_SIZE):
        self.size, self.langs = size, sorted({r["lang"] for r in rows})
        self.tables = []
        for lang in self.langs:
            pairs = sorted((r["code"], r["rank"]) for r in rows if r["lang"] == lang)
            self.tables.append((np.array([c for c, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int64)))

    def classify(self, text: str | None) -> tuple[str, float]:
        codes, counts = gram_counts(text or "")
        if not self.langs or not (codes > _EDGE).any() or not (codes < 1 << 21).any():
            return UNKNOWN, 0.0
        grams = _top(codes, counts, self.size)
        ranks, far = np.arange(len(grams)), []
        for known, at in self.tables:
            i = np.minimum(np.searchsorted(known, grams), len(known) - 1)
            far.append(np.where(known[i] == grams, np.minimum(np.abs(at[i] - ranks), self.size), self.size).sum())
        best = int(np.argmin(far))
        return self.langs[best], float(1 - far[best] / (self.size * len(grams)))


def identify(docs: DataFrame, profiles: DataFrame, text: str = "text", size: int = PROFILE_SIZE) -> DataFrame:
    """docs with lang_pred and score (1 - distance / largest distance); other columns stay, clashing ones are replaced."""
    has_columns(docs, text)
    model = Profiles(profiles.select("lang", "code", "rank").collect(), size)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def classify(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.classify(t) for t in texts], columns=["lang_pred", "score"])

    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*keep, classify(F.col(text)).alias("_found")).select(*keep, "_found.lang_pred", "_found.score")
