"""Embedding near-duplicates by spherical-cap filters.

Filters are unit directions with a structured product code: the rotated space is cut
into `parts` blocks, each block has `words` random unit vectors, and a direction is one
word of each block, joined and scaled; words ** parts directions need only
parts * words vectors.  `turns` rotations give independent codes, so that a vector which
one code serves badly is in caps of the others.  A vector is in the cap of every direction whose inner product
with it is at least `bar`; list decoding finds these without visiting all directions
(of the first block, words that the best of the others cannot lift over the bar fall
out).  Vectors at a small angle share caps with a probability near one, so vectors are
joined on (label, cap) and every pair that meets is verified by cosine in double
precision.

The filters follow the rows: fit_caps() sets the bar so that a cap holds about `company`
vectors of an evenly spread label of the size of the largest, whatever that is, and adds
turns until pairs made at the bound share a cap often enough.  What unrelated vectors
cost is then in proportion to the rows.  What a dense group costs follows the square of
its size, as each vector's links are counted; it is cut into tiles.

Hot caps: equal vectors collapse to one row with a count before anything else.  A cap's
members are compared in tiles of at most `tile` rows, each vector sent once to every
tile pair of its row or column, so no task holds a cap.  A pair that meets in
several caps counts only in the first cap both share.  A tile reports per vector how
many links it has there and the smallest vector that it reaches there, never its pairs.

Defined cases: vectors or labels that are null, zero vectors, and vectors with null or
non-finite components link with nothing; vectors of another dimension than the label's
others are compared only with their like; repeated and null ids are vectors of their own
and link like all others; a component's id is the smallest that is not null, null if all
are, and a null id is never the kept one; extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm.common import components, has_columns, materialize

COSINE = 0.93
#: Vectors of an evenly spread label that a cap holds, the recall of pairs at the bound that turns are added for, and the pairs that measure it.
COMPANY, RECALL, TRIALS = 8, 0.995, 2_000
TILE, MOST_TURNS, MOST_WORDS = 1_024, 128, 64


@dataclass(frozen=True)
class Caps:
    """The filters' parameters; bar is the least inner product of unit vectors of `dim` numbers."""

    dim: int
    bar: float
    parts: int
    words: int
    turns: int
    seed: int = 9

    def codes(self) -> list[tuple[np.ndarray, list[np.ndarray]]]:
        """For each turn a random rotation and each block's words."""
        return [_code(self.parts, self.words, self.seed, self.dim, turn) for turn in range(self.turns)]

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cap) of every cap that each unit vector is in, by row, then cap."""
        found = [self.decode_turn(unit, turn) for turn in range(self.turns)]
        row, cap = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((cap, row))
        return row[order], cap[order]

    def decode_turn(self, unit: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
        rotation, blocks = _code(self.parts, self.words, self.seed, self.dim, turn)
        turned = unit @ rotation
        cuts = np.array_split(np.arange(self.dim), self.parts)
        inner = [turned[:, c] @ w.T for c, w in zip(cuts, blocks, strict=True)]
        bar = self.bar * np.sqrt(self.parts)
        rest = [*np.cumsum([x.max(axis=1) for x in reversed(inner)], axis=0)[::-1][1:], np.zeros(len(unit))]  # the most that later blocks add
        row, cap, total = np.arange(len(unit)), np.full(len(unit), turn, np.int64), np.zeros(len(unit))
        for x, more in zip(inner, rest, strict=True):
            reach = total[:, None] + x[row]
            at, word = np.nonzero(reach + more[row][:, None] >= bar)
            row, cap, total = row[at], cap[at] * self.words + word, reach[at, word]
        return row, cap


@functools.lru_cache(maxsize=4 * MOST_TURNS)
def _code(parts: int, words: int, seed: int, dim: int, turn: int) -> tuple[np.ndarray, list[np.ndarray]]:
    rng = np.random.default_rng((seed, dim, turn))
    blocks = [rng.standard_normal((words, len(own))) for own in np.array_split(np.arange(dim), parts)]
    return np.linalg.qr(rng.standard_normal((dim, dim)))[0], [b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12) for b in blocks]


def _tail(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Inner products from 0 to 1, and the share of random unit vectors that reach each with a given one."""
    t = np.linspace(0, 1, 20_001)
    if dim < 3:
        return t, np.arccos(t) / np.pi if dim == 2 else np.full(len(t), 0.5)
    weight = (1 - t * t) ** ((dim - 3) / 2)
    return t, np.cumsum(weight[::-1])[::-1] / weight.sum() / 2


@functools.cache
def fit_caps(members: int, dim: int, cosine: float = COSINE, recall: float = RECALL) -> Caps:
    """Filters for a label of so many vectors of so many numbers; the same for the same arguments."""
    t, tail = _tail(dim)
    share = min(0.25, max(COMPANY / max(members, 1), float(tail[np.searchsorted(t, cosine)])))  # no smaller than what links anyway
    rng = np.random.default_rng((7, dim))
    x, y = rng.standard_normal((2, TRIALS, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = cosine * x + np.sqrt(1 - cosine * cosine) * y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    if dim == 1:
        y = x
    while True:
        directions = 1 / share
        parts = max(1, min(dim // 2, next(p for p in range(2, 99) if directions <= MOST_WORDS**p)))
        caps = Caps(dim, float(t[np.searchsorted(-tail, -share)]) if dim > 1 else 0.5, parts, max(2, round(directions ** (1 / parts))), MOST_TURNS)
        missed = np.arange(TRIALS)
        for turn in range(MOST_TURNS):
            a, b = (np.stack(caps.decode_turn(v[missed], turn), axis=1) for v in (x, y))
            met = np.unique(np.intersect1d(a.view([("r", a.dtype), ("c", a.dtype)]), b.view([("r", b.dtype), ("c", b.dtype)]))["r"])
            missed = np.delete(missed, met)
            if len(missed) <= (1 - recall) * TRIALS:
                return replace(caps, turns=turn + 1)
        if share >= 0.25:
            return caps
        share = min(0.25, 4 * share)  # so few share such caps that even all turns miss too many: larger caps


def distinct_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(label, vec, vec_id, n): usable vectors, equal ones as one row with the smallest id and their number."""
    has_columns(rows, key, vector, label)
    return rows.where(usable(vector, label)).groupBy(F.col(label).alias("label"), plain_numbers(vector).alias("vec")).agg(F.min(key).alias("vec_id"), F.count(F.lit(1)).alias("n"))


def usable(vector: str, label: str) -> Column:
    """Whether a row can link with anything."""
    vec = F.col(vector).cast("array<double>")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(label).isNotNull() & F.col(vector).isNotNull() & fine & F.exists(vec, lambda x: x != 0), F.lit(False))


def plain_numbers(vector: str) -> Column:
    return F.transform(F.col(vector).cast("array<double>"), lambda x: x + 0.0)  # -0.0 is 0.0


def mark_of(vec: Column) -> list[Column]:
    """128 bits that tell vectors apart, so that rows find theirs again without being sent whole."""
    return [F.xxhash64(vec, F.size(vec)), F.xxhash64(F.size(vec), F.reverse(vec))]


def fitted(vectors: DataFrame, cosine: float = COSINE) -> dict[int, Caps]:
    """Filters for each dimension, from the size of its largest label; a row for each dimension reaches the driver."""
    sizes = vectors.groupBy(F.size("vec").alias("dim"), "label").agg(F.count(F.lit(1)).alias("n")).groupBy("dim").agg(F.max("n").alias("n"))
    return {r["dim"]: fit_caps(r["n"], r["dim"], cosine) for r in sizes.collect()}


def coded(vectors: DataFrame, caps_of: dict[int, Caps], numbers: str = "<f8") -> DataFrame:
    """(label, dim, vec_id, n, v, caps): v has the numbers as bytes, caps the vector's caps in ascending order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, group in batch.groupby(batch["vec"].map(len)):
                for i in range(0, len(group), 512):
                    part = group.iloc[i : i + 512]
                    x = np.stack(part["vec"].to_numpy()).astype(np.float64)
                    scaled = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
                    row, cap = caps_of[dim].decode(scaled / np.linalg.norm(scaled, axis=1, keepdims=True))
                    lists = np.split(cap, np.cumsum(np.bincount(row, minlength=len(part)))[:-1])
                    yield pd.DataFrame({"label": part["label"].to_numpy(), "dim": np.int32(dim), "vec_id": part["vec_id"].to_numpy(), "n": part["n"].to_numpy(), "v": [v.astype(numbers).tobytes() for v in x], "caps": lists})

    return vectors.withColumn("label", F.col("label").cast("string")).mapInPandas(run, "label string, dim int, vec_id long, n long, v binary, caps array<long>")


def tiled(found: DataFrame, tile: int) -> DataFrame:
    """A row per vector, cap and tile pair (row <= col) that it takes part in; mine: its own tile.

    Caps of up to `tile` members are one tile (0, 0); caps with one member are left out.  A
    larger cap is cut into tiles by a hash of the id, and a member goes to every pair
    of its tile with each tile.  Vectors join last, so that they are dealt out once.
    """
    members = found.select("label", "dim", "vec_id", F.explode("caps").alias("cap"))
    sizes = members.groupBy("label", "dim", "cap").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    with_tile = members.join(sizes, ["label", "dim", "cap"]).withColumn("tiles", F.ceil(F.col("members") / tile).cast("int")).withColumn("mine", F.pmod(F.xxhash64("vec_id"), F.col("tiles")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least("mine", o).alias("row"), F.greatest("mine", o).alias("col")))
    spots = with_tile.select("label", "dim", "cap", "mine", F.explode(pairs).alias("pair"), "vec_id").select("label", "dim", "cap", "pair.row", "pair.col", "mine", "vec_id")
    return spots.join(found.select("vec_id", "label", "dim", "n", "v", "caps"), ["vec_id", "label", "dim"])


def _compare(ids: np.ndarray, counts: np.ndarray, x: np.ndarray, caps: list[np.ndarray], side: np.ndarray, row: int, col: int, cap: int, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of one tile pair: ids that have any, the number of their links here, the smallest id each reaches here."""
    length = np.sqrt((x * x).sum(axis=1))
    unit = x / length[:, None]
    close = unit @ unit.T >= cosine - 1e-9
    np.fill_diagonal(close, False)
    if row != col:
        close &= side[:, None] != side[None, :]
    a, b = np.nonzero(np.triu(close))
    if not len(a):
        return ids[:0], counts[:0], ids[:0]
    lower = [c[c < cap] for c in caps]
    named, at = np.unique(np.concatenate(lower), return_inverse=True)
    steps = range(0, len(a), 65_536)
    if len(named):  # pairs that share a smaller cap count there
        flags = np.zeros((len(ids), len(named)), np.float32)
        flags[np.repeat(np.arange(len(ids)), [len(c) for c in lower]), at] = 1
        fresh = np.concatenate([(flags[a[i : i + 65_536]] * flags[b[i : i + 65_536]]).sum(axis=1) == 0 for i in steps]) if len(a) < 8 * len(ids) else (flags @ flags.T == 0)[a, b]
        a, b = a[fresh], b[fresh]
    steps = range(0, len(a), 65_536)
    exact = [(x[a[i : i + 65_536]] * x[b[i : i + 65_536]]).sum(axis=1) / (length[a[i : i + 65_536]] * length[b[i : i + 65_536]]) >= cosine for i in steps]
    exact = np.concatenate([np.empty(0, bool), *exact])
    a, b = a[exact], b[exact]
    links = np.bincount(a, counts[b], len(ids)) + np.bincount(b, counts[a], len(ids))
    least = ids.copy()
    while True:
        before = least.copy()
        np.minimum.at(least, a, before[b])
        np.minimum.at(least, b, before[a])
        if (least == before).all():
            break
    found = np.flatnonzero(links)
    return ids[found], links[found].astype(np.int64), least[found]


def compared(tiles: DataFrame, cosine: float = COSINE, numbers: str = "<f8") -> DataFrame:
    """(vec_id, links, least): partial counts and reach, from every tile pair."""
    keys = ["label", "dim", "cap", "row", "col"]

    def flush(rows: pd.DataFrame) -> list[tuple]:
        out = []
        change = np.flatnonzero(np.concatenate(([True], (rows[keys].to_numpy()[1:] != rows[keys].to_numpy()[:-1]).any(axis=1)))).tolist() + [len(rows)]
        cap, row, col = rows["cap"].to_numpy(), rows["row"].to_numpy(), rows["col"].to_numpy()
        ids, counts, mine, v, caps = (rows[c].to_numpy() for c in ("vec_id", "n", "mine", "v", "caps"))
        for i, j in zip(change, change[1:], strict=False):
            if j - i > 1:
                x = np.frombuffer(b"".join(v[i:j]), numbers).astype(np.float64).reshape(j - i, -1)
                out.append(_compare(ids[i:j], counts[i:j], x, [*caps[i:j]], mine[i:j], row[i], col[i], cap[i], cosine))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # rows of a group that may go on in the next batch: two tiles at most
        for batch in batches:
            held.append(batch)
            first, last = (tuple(batch[keys].iloc[i]) for i in (0, -1))
            if first == last and len(held) > 1 and tuple(held[0][keys].iloc[0]) == last:
                continue
            rows = pd.concat(held, ignore_index=True)
            cut = int((rows[keys] != pd.Series(last, keys)).any(axis=1).to_numpy().nonzero()[0][-1]) + 1 if first != last or len(held) > 1 else 0
            held = [rows.iloc[cut:]]
            if cut:
                yield from _frames(flush(rows.iloc[:cut]))
        if held:
            yield from _frames(flush(pd.concat(held, ignore_index=True)))

    grouped = tiles.repartition(*keys).sortWithinPartitions(*keys)
    return grouped.mapInPandas(run, "vec_id long, links long, least long")


def _frames(found: list[tuple]) -> Iterator[pd.DataFrame]:
    if found:
        yield pd.DataFrame({n: np.concatenate([f[i] for f in found]).astype(np.int64) for i, n in enumerate(("vec_id", "links", "least"))})


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    # numbers of their own tell distinct vectors apart: ids may be null or repeated
    vectors = materialize(distinct_vectors(rows, key, vector, label).withColumn("number", F.monotonically_increasing_id()))
    inner = vectors.select("label", "vec", F.col("number").alias("vec_id"), "n")
    single = rows.schema[vector].dataType == T.ArrayType(T.FloatType(), rows.schema[vector].dataType.containsNull)
    numbers = "<f4" if single else "<f8"  # the numbers as they are
    partial = materialize(compared(tiled(materialize(coded(inner, fitted(inner, cosine), numbers)), tile), cosine, numbers))
    roots = components(partial.select(F.col("vec_id").alias("a"), F.col("least").alias("b")))
    links = partial.groupBy(F.col("vec_id").alias("number")).agg(F.sum("links").alias("links"))
    marks = [m.alias(f"_m{i}") for i, m in enumerate(mark_of(F.col("vec")))]
    marked = vectors.select(F.col("label").alias("_label"), *marks, "number", "vec_id", "n").join(links, "number", "left").join(roots, F.col("number") == F.col("node"), "left")
    marked = materialize(marked.select("_label", "_m0", "_m1", "vec_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("_links"), F.coalesce("root", "number").alias("_root")))
    least = marked.groupBy("_root").agg(F.min("vec_id").alias("_least"))
    told = materialize(marked.join(least, "_root").select("_label", "_m0", "_m1", "_links", "_least", F.lit(True).alias("_told")))
    own = [F.when(usable(vector, label), m).alias(f"_m{i}") for i, m in enumerate(mark_of(plain_numbers(vector)))]
    joined = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("_label"), *own).join(told, ["_label", "_m0", "_m1"], "left")
    component = F.when(F.col("_told"), F.col("_least")).otherwise(F.col("vec_id")).cast("long")
    found = joined.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
