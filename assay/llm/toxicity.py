"""Toxicity by weak supervision.

Voters: word lexicons and patterns written down here, and lexicons of stems (words and
their first 4 to 6 letters, by how many words of a text have them) mined from labelled rows for standing in toxic texts far more
often than in others, dealt out by strength so that each lexicon speaks for all languages.
A generative label model, fitted by expectation maximisation on the votes alone,
estimates how often each voter fires on either class and which voters depend on each
other given the class: those form a forest (the heaviest by conditional mutual
information), in which a voter's rate on either class also depends on its parent's vote.
So ten names of one signal do not count ten times.  A linear classifier on stems and
voters is trained on the posterior labels and scores every text.

Written voters need no label.  Labels are used to mine stems, for the share of toxic
rows and, at the end, to set the scale of the scores; the label model does not see them.  At most about `rows` labelled rows, chosen by a hash of their key,
teach; everything else covers all rows.

Defined cases: null and empty texts have no feature and get the score of a text without
any sign (the bias); without labels only the written voters speak; equal texts teach
once, as toxic if any of their labels says so; extra columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import has_columns, materialize, text_or_empty

#: The classifier learns from about this many labelled rows.
ROWS = 20_000
#: Mined stems that are features, and the lexicons that they are dealt out to.
STEMS, LEXICA = 512, 12
THRESHOLD = 0.7
#: Written voters, as words in lower case and as patterns.
LEXICONS = {
    "insult": ("idiot", "moron", "stupid", "dumb", "fool", "imbecile", "loser", "clown"),
    "contempt": ("scum", "trash", "worthless", "pathetic", "disgusting", "filth", "vermin"),
    "hate": ("hate", "despise", "loathe"),
    "threat": ("kill", "hurt", "destroy", "die"),
    "insult de": ("idiot", "trottel", "depp", "dummkopf", "versager", "blödmann", "arschloch"),
    "contempt de": ("abschaum", "dreck", "wertlos", "erbärmlich", "widerlich", "ungeziefer"),
    "insult es": ("idiota", "imbécil", "estúpido", "estúpida", "tonto", "tonta", "payaso"),
    "contempt es": ("escoria", "basura", "inútil", "patético", "asqueroso", "asquerosa"),
    "insult fr": ("idiot", "idiote", "imbécile", "stupide", "crétin", "abruti", "connard"),
    "contempt fr": ("ordure", "déchet", "minable", "pathétique", "dégoûtant", "vermine"),
}
PATTERNS = {
    "address": r"\b[Yy]ou(?:'re| are)? (?:an? )?(?:\w+ )?(?:idiot|moron|loser|fool|scum|trash|clown)\b",
    "masked": r"\b\w+\*{2,}\w+\b",
    "spelled": r"(?i)\b(?:1d[i1]ot|[i1]d[i1]0t|m[0o]r0n|stup1d|l0[sz]er|tr[4@]sh|5cum)\b",
    "wish": r"(?i)\b(?:shut up|go to hell|drop dead|halt die klappe|cállate|ferme-la)\b",
    "shouting": r"(?:\b[A-Z]{4,}\b\W+){3,}",
    "banging": r"[!?]{3,}",
}
_WORDS = re.compile(r"[^\W\d_]+").findall
_WRITTEN: dict[str, list[str]] = {}
for _name, _words in LEXICONS.items():
    for _word in _words:
        _WRITTEN.setdefault(_word, []).append(f"lexicon:{_name}")
_PATTERNS = {f"pattern:{name}": re.compile(p).search for name, p in PATTERNS.items()}
WRITTEN = (*(f"lexicon:{n}" for n in LEXICONS), *_PATTERNS)
_REMEMBERED = 400_000


#: A stem is also a feature of texts with so many different words that begin with it.
TIMES = (2, 4)


def stems(word: str) -> tuple[str, ...]:
    return (word, *(f"{word[:n]}-" for n in (4, 5, 6) if len(word) > n))


def stems_of(words: set[str]) -> set[str]:
    """All stems of a text's words; `abcd-4` is that of a text with four or more words in abcd."""
    counted = Counter(s for w in words for s in stems(w))
    return {*counted, *(f"{s}{n}" for s, times in counted.items() for n in TIMES if times >= n and s[-1] == "-")}


class Features:
    """Finds which of the known features a text has; words are remembered up to a bound."""

    def __init__(self, names: list[str]):
        self.at, self.memo = {n: i for i, n in enumerate(names)}, {}
        self.often: dict[str, list[tuple[int, int]]] = {}  # by stem: how many words make which feature
        for n, i in self.at.items():
            if n[-1].isdigit() and n[-2:-1] == "-":
                self.often.setdefault(n[:-1], []).append((int(n[-1]), i))

    def _of(self, word: str) -> tuple[str, ...]:
        low = word.lower()
        names = [s for s in stems(low) if s in self.at or s in self.often]
        names += _WRITTEN.get(low, ())
        return tuple(names)

    def find(self, text: str) -> set[int]:
        if len(self.memo) > _REMEMBERED:
            self.memo = {}
        hits: dict[str, set[str]] = {}
        for w in set(_WORDS(text)):
            named = self.memo.get(w)
            if named is None:
                named = self.memo[w] = self._of(w)
            for n in named:
                hits.setdefault(n, set()).add(w.lower())
        found = {self.at[n] for n in hits if n in self.at}
        found.update(i for stem, features in self.often.items() if stem in hits for times, i in features if len(hits[stem]) >= times)
        found.update(self.at[n] for n, search in _PATTERNS.items() if n in self.at and search(text))
        return found


def mine(rows: DataFrame, size: int = STEMS) -> list[str]:
    """Stems with the most evidence for toxic = 1 in rows(text, toxic), the strongest first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = (Counter(), Counter())
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                seen[int(toxic)].update(stems_of({w.lower() for w in _WORDS(text)}))
            names = list(seen[1]) + [s for s in seen[0] if s not in seen[1]]
            yield pd.DataFrame({"stem": names, "bad": [seen[1][s] for s in names], "good": [seen[0][s] for s in names]}).astype({"bad": "int64", "good": "int64"})

    sums = rows.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    bad, good = int(sums[0] or 0), int(sums[1] or 0)
    if not bad or not good:
        return []
    counted = rows.mapInPandas(count, "stem string, bad long, good long").groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    rate_bad, rate_good = (F.col("bad") + 0.5) / (bad + 1), (F.col("good") + 0.5) / (good + 1)
    evidence = F.col("bad") * F.log(rate_bad / rate_good)
    strong = counted.where((F.col("bad") >= max(5, 0.01 * bad)) & (rate_bad > 20 * rate_good) & (evidence > 30)).orderBy(F.desc(evidence), "stem").limit(size)  # a top-k report
    return [r["stem"] for r in strong.select("stem").collect()]


def vote(found: np.ndarray, lexica: int = LEXICA) -> tuple[np.ndarray, list[str]]:
    """Votes (rows x voters) from features (rows x features), and the voters' names: the written voters, then mined lexicons; voters that never fire are left out."""
    mined = found[:, len(WRITTEN) :]
    dealt = [mined[:, i::lexica].any(axis=1) for i in range(min(lexica, mined.shape[1]))]
    votes = np.concatenate((found[:, : len(WRITTEN)], np.array(dealt, bool).reshape(len(dealt), len(found)).T), axis=1)
    names = [*WRITTEN, *(f"mined:{i}" for i in range(len(dealt)))]
    fires = votes.any(axis=0)
    return votes[:, fires], [n for n, f in zip(names, fires, strict=True) if f]


@dataclass
class LabelModel:
    """P(class) and, for each voter, P(vote | class, vote of its parent).

    rates[c, j]: how often voter j fires on class c; parents[j]: the voter that j depends
    on given the class, or -1; given[c, u, j]: how often j fires on class c when its
    parent votes u; correlations: of voters given the class.
    """

    prior: float
    rates: np.ndarray = field(default_factory=lambda: np.empty((2, 0)))
    parents: np.ndarray = field(default_factory=lambda: np.empty(0, int))
    given: np.ndarray = field(default_factory=lambda: np.empty((2, 2, 0)))
    correlations: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))

    def fit(self, votes: np.ndarray, rounds: int = 60) -> np.ndarray:
        """Fit to votes (rows x voters, bool); returns the posterior of class 1."""
        x, n = votes.astype(np.float64), votes.shape[1]
        self.parents = np.full(n, -1)
        post = np.where(votes.any(axis=1), 0.9, 0.01)  # to begin with, any vote is believed
        for i in range(rounds):
            self._rate(x, post)
            if i % 10 == 9 or not i:
                self.parents = self._forest(x, post)
            self._rate_given(x, post)
            new = self.posterior(votes)
            if np.abs(new - post).max(initial=0) < 1e-6 and i > 20:
                break
            post = new
        return post

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(class 1 | votes)."""
        rows, n = votes.shape
        above = np.where(self.parents >= 0, votes[:, self.parents], 0).astype(int)
        p = self.given[:, above, np.arange(n)]  # class x rows x voters
        evidence = np.log(np.where(votes, p, 1 - p)).sum(axis=2)
        odds = np.log(self.prior / (1 - self.prior)) + evidence[1] - evidence[0]
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))

    def _rate(self, x: np.ndarray, post: np.ndarray) -> None:
        total = np.array([(1 - post).sum(), post.sum()])
        self.rates = np.clip(np.stack(((1 - post) @ x + 0.1, post @ x + 0.1)) / (total[:, None] + 1), 1e-4, 1 - 1e-4)

    def _rate_given(self, x: np.ndarray, post: np.ndarray) -> None:
        above = np.where(self.parents >= 0, x[:, self.parents], 0)
        self.given = np.empty((2, 2, x.shape[1]))
        for c, w in enumerate((1 - post, post)):
            for u, on in enumerate((1 - above, above)):
                seen, fired = w @ on, w @ (on * x)
                self.given[c, u] = np.clip((fired + 2 * self.rates[c]) / (seen + 2), 1e-4, 1 - 1e-4)  # few rows: near the rate of the class

    def _forest(self, x: np.ndarray, post: np.ndarray) -> np.ndarray:
        """Each voter's parent in the heaviest forest of pairs that depend on each other given the class beyond chance."""
        rows, n = x.shape
        information, covariance = np.zeros((n, n)), np.zeros((n, n))
        for w in (1 - post, post):
            total, both, one = w.sum() + 1e-9, (x * w[:, None]).T @ x, w @ x
            joint = {(1, 1): both, (1, 0): one[:, None] - both, (0, 1): one[None, :] - both, (0, 0): total - one[:, None] - one[None, :] + both}
            margin = {1: one, 0: total - one}
            for (a, b), m in joint.items():
                m = np.maximum(m, 0)
                expected = margin[a][:, None] * margin[b][None, :] / total
                information += np.where((m > 0) & (expected > 0), m * np.log(np.maximum(m, 1e-12) / np.maximum(expected, 1e-12)), 0)
            covariance += both - one[:, None] * one[None, :] / total
        spread = np.sqrt(np.maximum(np.diag(covariance), 1e-9))
        self.correlations = covariance / spread[:, None] / spread
        strong = (2 * information > 20) & (np.abs(self.correlations) > 0.1)  # chance: 2 on average, over 20 in 1 of 20,000
        parents, inside = np.full(n, -1), np.zeros(n, bool)
        for start in range(n):
            if inside[start]:
                continue
            inside[start] = True
            best, via = np.where(strong[start], information[start], 0.0), np.full(n, start)
            while True:
                best[inside] = 0
                j = int(best.argmax())
                if best[j] <= 0:
                    break
                parents[j], inside[j] = via[j], True
                better = strong[j] & (information[j] > best)
                best, via = np.where(better, information[j], best), np.where(better, j, via)
        return parents


def fit_linear(x: np.ndarray, target: np.ndarray, ridge: float = 0.1, rounds: int = 500) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient steps; (weights, bias)."""
    x = np.concatenate((x.astype(np.float32), np.ones((len(x), 1), np.float32)), axis=1)
    w = np.zeros(x.shape[1], np.float32)
    v = w.copy()
    penalty = np.full(len(w), ridge, np.float32)
    penalty[-1] = 0
    step = 4 / (np.linalg.norm(x, 2) ** 2 + 4 * ridge)
    for i in range(rounds):
        gradient = x.T @ (1 / (1 + np.exp(-np.clip(x @ v, -30, 30))) - target.astype(np.float32)) + penalty * v
        new = v - step * gradient
        v, w = new + i / (i + 3) * (new - w), new
    return w[:-1].astype(np.float64), float(w[-1])


@dataclass
class Model:
    names: list[str]
    weights: np.ndarray
    bias: float
    label_model: LabelModel
    voters: list[str] = field(default_factory=list)

    def report(self) -> list[tuple[str, float, float, str | None]]:
        """(voter, share of toxic texts and of others that it fires on, the voter it depends on) as the label model estimates them."""
        m = self.label_model
        return [(v, float(m.rates[1, j]), float(m.rates[0, j]), self.voters[m.parents[j]] if m.parents[j] >= 0 else None) for j, v in enumerate(self.voters)]


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = ROWS) -> Model:
    """A model from labelled(key, text, label 0/1), of which about `rows` rows teach."""
    has_columns(labelled, key, text, label)
    known = labelled.where(F.col(label).isin(0, 1)).select(text_or_empty(text).alias("text"), F.col(label).cast("int").alias("toxic"))
    known = materialize(known.groupBy(F.md5(F.col("text").cast("binary"))).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"))  # copies would vote many times
    names = [*WRITTEN, *mine(known)]
    finder = Features(names)

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "found": [sorted(finder.find(t)) for t in batch["text"]]})

    sample = known.mapInPandas(match, "toxic int, found array<int>").toPandas()  # about `rows` rows of some numbers
    x = np.zeros((len(sample), len(names)), bool)
    for i, found in enumerate(sample["found"]):
        x[i, list(found)] = True
    prior = float(np.clip(sample["toxic"].mean(), 0.01, 0.5)) if len(sample) else 0.05
    (votes, voters), model = vote(x), LabelModel(prior)
    if not votes.size:
        weights = np.array([3.0 if n.startswith("lexicon") else 1.0 for n in names])
        return Model(names, weights, -2.0, model)
    weights, bias = fit_linear(x, model.fit(votes))
    (slope,), shift = fit_linear((x @ weights + bias)[:, None], sample["toxic"].to_numpy(), ridge=0.01)  # calibrated on the labels
    if slope > 0:
        weights, bias = weights * slope, bias * slope + shift
    return Model(names, weights, bias, model, voters)


def bounded(labels: DataFrame, key: str = "doc_id", rows: int = ROWS) -> DataFrame:
    """About `rows` of the labels at most, chosen by a hash of their key."""
    n = labels.count()
    return labels.where(F.pmod(F.xxhash64(F.lit("teach"), F.col(key)), F.lit(1_000_000)) < 1_000_000.0 * rows / max(n, 1))


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted; other columns stay, clashing ones are replaced."""
    has_columns(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast((Features(model.names), model.weights, model.bias))

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        finder, weights, bias = shared.value
        sums = np.array([bias + sum(weights[i] for i in finder.find(t)) for t in texts])
        return pd.Series(1 / (1 + np.exp(-np.clip(sums, -40, 40))))

    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    return docs.select(*keep, run(text_or_empty(text)).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
