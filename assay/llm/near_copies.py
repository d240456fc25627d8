"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Words and shingles are those of simhash.  Candidates are texts that share a band, five
of 125 least hashes (MinHash): a pair at 0.8 shares none of the 25 bands with
probability 0.00005.  Candidates are then compared on the whole sets of their shingles'
hashes, so no link is below the bound.

A band of more than `bucket` texts would give all their pairs.  Its texts are first
compared with four of them, each the one of a hashed quarter that has most company in
its bands, as the text that the others are made from has; each band deals quarters anew.
What is joined by then need not be compared again.  Of a crowded band whose texts are
still in several components, those outside the largest are compared exactly with all the
others, in tiles of a bounded size that report joined components and never pairs.  So
components are those of all candidate pairs, at a cost that follows a band's size times
the texts outside its largest component.

Defined cases: texts equal up to case and white space are one text; a text of up to
five words is one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm import simhash
from assay.llm.common import components, has_columns, materialize, text_or_empty

WIDTH, BANDS, BAND_ROWS = 5, 25, 5
BUCKET, QUARTERS = 16, 4
#: Parts that the pairs of one text with very many others are dealt to.
PARTS = 256
#: Texts, and shingles, that one side of a tile holds at most (a text of more shingles is a side of its own).
TILE, TILE_SHINGLES = 512, 1 << 21
_CHUNK = 1 << 10
_MARKS = f"place {simhash.PLACE}, fp long, tid long, size int, bands array<long>"


def _mixers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(simhash.SEED)
    flips, factors = rng.integers(0, 1 << 64, (2, BANDS * BAND_ROWS), dtype=np.uint64)
    return flips, factors | np.uint64(1)


FLIPS, FACTORS = _mixers()


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.unique(np.array([digest(join(words[i : i + width]), simhash.SEED) for i in range(max(1, len(words) - width + 1))], dtype=np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    least = np.full(len(FLIPS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), _CHUNK):
        np.minimum(least, ((hashes[i : i + _CHUNK, None] ^ FLIPS) * FACTORS).min(axis=0), out=least)
    rows = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), number) for number, row in enumerate(rows)], dtype=np.uint64)


def marks(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(place, fp, tid, size, bands) for every row: its fingerprint, hash of its words, number of distinct shingles, bands."""
    has_columns(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty((batch.num_rows, 2), np.uint64)
            sizes, found = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                own = shingles(t)
                out[i] = simhash.fingerprint(t, width), xxhash.xxh64_intdigest(b" ".join(t.encode("utf-8", "surrogatepass").lower().split()), simhash.SEED)
                sizes.append(len(own))
                found.append(bands(own))
            flat = np.concatenate(found) if found else np.empty(0, np.uint64)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS), pa.int32()), pa.array(flat.view(np.int64)))
            fp, tid = (pa.array(np.ascontiguousarray(out[:, c]).view(np.int64)) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), fp, tid, pa.array(sizes, pa.int32()), listed], names=["place", "fp", "tid", "size", "bands"])

    return docs.select(simhash.place(key, text).alias("place"), text_or_empty(text).alias("text")).mapInArrow(run, _MARKS)


def _sets(rows: DataFrame) -> DataFrame:
    """(tid, set array<long>) of rows (tid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = shingles(text).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([tid], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), pa.array(own))], names=["tid", "set"])

    return rows.mapInArrow(run, "tid long, set array<long>")


def distinct_texts(marked: DataFrame) -> DataFrame:
    """(tid, fp, place, size, bands): one row for each text of marked."""
    return marked.groupBy("tid").agg(F.min("fp").alias("fp"), F.min("place").alias("place"), F.min("size").alias("size"), F.min("bands").alias("bands"))


def shared_bands(texts: DataFrame) -> DataFrame:
    """(band, tid, size, entries) of bands with several texts."""
    own = texts.select("tid", "size", F.explode("bands").alias("band"))
    table = own.groupBy("band").agg(F.count(F.lit(1)).alias("entries")).where("entries > 1")
    return own.join(table.hint("shuffle_hash"), "band")


def candidates(hits: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b) tids of pairs to compare first: all of small bands, of crowded ones some; a text is `a` in a bounded number of them."""
    few = hits.where(F.col("entries") <= bucket)
    other = few.select("band", F.col("tid").alias("b"), F.col("size").alias("b_size"))
    pairs = few.withColumnRenamed("tid", "a").join(other, "band").where("a < b")

    many = hits.where(F.col("entries") > bucket)
    company = hits.groupBy("tid").agg(F.sum("entries").alias("company"))
    quarter = F.pmod(F.xxhash64("tid", "band"), F.lit(QUARTERS))
    chosen = many.join(company, "tid").groupBy("band", quarter.alias("quarter")).agg(F.max(F.struct("company", "tid", "size")).alias("c"))
    stars = many.withColumnRenamed("tid", "a").join(chosen.select("band", F.col("c.tid").alias("b"), F.col("c.size").alias("b_size")), "band").where("a != b")
    alike = "5 * least(size, b_size) >= 4 * greatest(size, b_size)"
    return pairs.select("a", "b", "size", "b_size").unionByName(stars.select("a", "b", "size", "b_size")).where(alike).select("a", "b").distinct()


def shingle_sets(docs: DataFrame, texts: DataFrame, hits: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(tid, set, fp) of the texts that share a band."""
    held = simhash.rows_at(docs, texts.join(hits.select("tid").distinct(), "tid").select("tid", "place"), key, text)
    return _sets(held.select("tid", text_or_empty(f"_row.{text}").alias("text"))).join(texts.select("tid", "fp"), "tid")


def links(hits: DataFrame, sets: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): fingerprints of candidates that are near copies."""
    pairs = materialize(candidates(hits, bucket).withColumn("part", F.pmod(F.xxhash64("a"), F.lit(PARTS))))
    # a text that very many are compared with is copied to the parts that need it
    copied = pairs.select("b", "part").distinct().join(sets.toDF("b", "b_set", "b_fp"), "b")
    both = pairs.join(copied, ["b", "part"]).join(sets.toDF("a", "a_set", "a_fp"), "a")
    shared = F.size(F.array_intersect("a_set", "b_set"))
    return both.withColumn("shared", shared).where("5 * shared >= 4 * (size(a_set) + size(b_set) - shared)").select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b")).where("a != b").distinct()


def strays(hits: DataFrame, fps: DataFrame, roots: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(band, tid, root, away, rows, cols): members of crowded bands with several components.

    roots(node, root) has the components so far by fingerprint, fps(tid, fp) the texts'
    fingerprints.  away: outside the band's largest component; rows, cols: tiles that the
    away ones, and all, are cut into.
    """
    named = fps.join(roots, fps["fp"] == roots["node"], "left").select("tid", F.coalesce("root", "fp").alias("root"))
    rooted = hits.where(F.col("entries") > bucket).join(named, "tid")
    shares = rooted.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    bands_of = shares.groupBy("band").agg(F.sum("n").alias("members"), F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "root")).alias("home"), F.max("size").alias("longest"))
    per = F.greatest(F.lit(1), F.least(F.lit(TILE), F.floor(F.lit(TILE_SHINGLES) / F.col("longest"))))
    tiles = lambda n: F.ceil(n / per).cast("int")
    cut = materialize(bands_of.where("parts > 1").select("band", F.col("home.root").alias("home"), tiles(F.col("members") - F.col("home.n")).alias("rows"), tiles(F.col("members")).alias("cols")))
    return rooted.join(cut, "band").select("band", "tid", "root", (F.col("root") != F.col("home")).alias("away"), "rows", "cols")


def _tile(group: pd.DataFrame) -> pd.DataFrame:
    """Components (a, b) of one tile that are joined by a pair of an away text and another: each with the least that it reaches here."""
    away = group["away"].to_numpy()
    sets, root, size = group["set"].to_numpy(), group["root"].to_numpy(), group["set"].map(len).to_numpy()
    named, at = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(at) > 1
    column = np.cumsum(often) - 1  # shingles of one text only are shared with none
    text = np.repeat(np.arange(len(size)), size)
    text, at = text[often[at]], column[at[often[at]]]
    order = np.argsort(at, kind="stable")
    text, at = text[order], at[order]
    a, b = np.flatnonzero(away), np.flatnonzero(~away)
    shared = np.zeros((len(a), len(b)), np.float32)
    for i in range(0, int(often.sum()), 4096):
        lo, hi = np.searchsorted(at, (i, i + 4096))
        flags = np.zeros((len(size), 4096), np.float32)
        flags[text[lo:hi], at[lo:hi] - i] = 1
        shared += flags[a] @ flags[b].T
    shared = np.rint(shared).astype(np.int64)
    i, j = np.nonzero((5 * shared >= 4 * (size[a][:, None] + size[b][None, :] - shared)) & (root[a][:, None] != root[b][None, :]))
    ends = np.unique(np.stack((np.minimum(root[a][i], root[b][j]), np.maximum(root[a][i], root[b][j])), axis=1), axis=0)
    return pd.DataFrame({"a": ends[:, 0], "b": ends[:, 1]})


def rest(hits: DataFrame, sets: DataFrame, roots: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): components of roots that crowded bands join further; every pair of a band that roots leaves apart is compared."""
    members = materialize(strays(hits, sets.select("tid", "fp"), roots, bucket))
    mine = lambda n: F.pmod(F.xxhash64("tid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = members.where("away").select("band", "tid", "root", "away", mine("rows").alias("row"), every("cols").alias("col"))
    cols = members.select("band", "tid", "root", F.lit(False).alias("away"), every("rows").alias("row"), mine("cols").alias("col"))
    placed = rows.unionByName(cols).join(sets.select("tid", "set"), "tid")
    return placed.groupBy("band", "row", "col").applyInPandas(_tile, "a long, b long").distinct()


def joined(docs: DataFrame, marked: DataFrame, links_so_far: DataFrame, key: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(node, root): components of fingerprints that links_so_far(a, b) and near copies among docs join; marked as marks() gives it, written."""
    texts = materialize(distinct_texts(marked))
    hits = materialize(shared_bands(texts))
    sets = materialize(shingle_sets(docs, texts, hits, key, text))
    first = materialize(components(links_so_far.unionByName(links(hits, sets, bucket))))
    return components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(rest(hits, sets, first, bucket)))
