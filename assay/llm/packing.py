"""Best-fit packing of documents into sequences, large items by matching.

A document's pieces are its token ids cut every `capacity` ids.  Pieces above a third of
the capacity are large: at most two fit a sequence, and they are matched greedily, the
largest left with the largest that still fits beside it.  Smaller pieces, largest
first, go into the sequence with the smallest gap that holds them, or open a new one.

Which piece of a length goes where does not matter to the fill, so the packing is
planned on the histogram of lengths (at most `capacity` numbers, whatever the corpus)
and yields placements: so many pieces of a length, from a rank on, go to sequences from
a number on, at an offset.  Sequences that are filled alike are one range, so the number
of placements follows the distinct lengths, not the pieces.  Pieces then get their rank within their length, taken in
cells so that no task holds all pieces of a common length, and look up their placement.

Defined cases: null text is empty and gives the end id only; equal pieces are
interchangeable; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import group_rank, has_columns, materialize, spread, text_or_empty

CAPACITY = 4096
END_ID = 1
#: Distinct runs whose ids a worker process remembers before the runs of before that are forgotten.
REMEMBERED = 600_000
#: Characters of text that are encoded together.
TOGETHER = 1 << 23


class WordEncoder:
    """Ids of whole texts, as the tokenizer file gives them.

    The tokenizer lower-cases, drops white space and cuts words into runs of letters,
    single digits and runs of other signs, each encoded by itself.  So a text's ids are
    its words' ids in a row and a word's those of its runs.  Arrow cuts texts into words
    and the distinct words into runs; only distinct runs that are new go to the
    tokenizer, together, and ids are put in a row by position.  Words with characters
    that other rules touch go to the tokenizer whole.
    """

    _run = r"('s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+)"
    _other = r"[^\x20-\x{12f}\x{131}-\x{17f}]|<\|"
    _odd_space = re.compile("[\x1c-\x1f]").search
    _whole = "\x1f"  # stands before words that are not cut; a word has no white space

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        # what has been seen of late, and what was before that
        self.runs: dict[str, bytes] = {}
        self.old_runs: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype="<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of_runs(self, runs: list[str]) -> list[bytes]:
        """The ids of each run; many are encoded as one text and cut where words end."""
        out = []
        for i in range(0, len(runs), 512):
            part = runs[i : i + 512]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part):
                out += self._ids(part)
                continue
            data, at = ids.tobytes(), 0
            for end in (4 * ends).tolist():
                out.append(data[at:end])
                at = end
        return out

    def _learn(self, runs: list[str]) -> None:
        if len(self.runs) + len(runs) > REMEMBERED:
            self.runs, self.old_runs = {}, self.runs
        known, old = self.runs, self.old_runs
        unknown = [r for r in runs if r not in known]
        known.update((r, old[r]) for r in unknown if r in old)
        new = [r for r in unknown if r not in old]
        for whole, encode in ((False, self._ids_of_runs), (True, self._ids)):
            listed = [r for r in new if r.startswith(self._whole) == whole]
            known.update(zip(listed, encode([r.removeprefix(self._whole) for r in listed]), strict=True))

    def _ids_of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words in a row, and where each word's begin, with the end of the last."""
        cut = pc.replace_substring_regex(pc.utf8_lower(words), self._run, r"\1 ")
        units = pc.split_pattern(pc.if_else(pc.match_substring_regex(words, self._other), pc.binary_join_element_wise(self._whole, words, ""), cut), " ")
        runs = units.flatten().dictionary_encode()
        named = runs.dictionary.to_pylist()
        self._learn(named)
        ids = [self.runs[r] if r else b"" for r in named]
        starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)))
        return _gathered(np.frombuffer(b"".join(ids), "<u4"), starts, runs.indices.to_numpy(zero_copy_only=False), units.offsets.to_numpy())

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        odd = {i: t for i, t in enumerate(texts.to_pylist()) if self._odd_space(t)}
        words = pc.utf8_split_whitespace(texts)
        named = words.flatten().dictionary_encode()
        ids, starts = self._ids_of_words(named.dictionary)
        ids, starts = _gathered(ids, starts, named.indices.to_numpy(zero_copy_only=False), words.offsets.to_numpy())
        for i, (a, b) in enumerate(zip(starts.tolist(), starts[1:].tolist(), strict=False)):
            yield np.frombuffer(self._ids([odd[i]])[0], "<u4") if i in odd else ids[a:b]


def _gathered(flat: np.ndarray, starts: np.ndarray, wanted: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The wanted stretches of flat (stretch i begins at starts[i]) in a row, and where each group of stretches begins, with the end of the last."""
    wanted = wanted[groups[0] : groups[-1]]
    size = (starts[1:] - starts[:-1])[wanted]
    ends = np.concatenate(([0], np.cumsum(size)))
    at = np.repeat(starts[:-1][wanted] - ends[:-1], size)
    at += np.arange(len(at))
    return flat[at], ends[groups - groups[0]]


@functools.cache
def encoder_for(path: str) -> WordEncoder:
    """One encoder for a worker process, whatever number of tasks it runs."""
    return WordEncoder(path)


def _slices(batch: pa.RecordBatch, column: int, size: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `size` bytes of the column, one row at least."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(first, last - first)
        first = last


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""
    has_columns(docs, key, text)
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer)
        for batch in batches:
            for part in _slices(batch, 1):
                out = []
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1)), strict=True):
                    n, data = len(ids) + 1, ids.tobytes() + end.tobytes()
                    out += [(doc, i, a, min(capacity, n - a), zlib.crc32(data[4 * a : 4 * (a + capacity)])) for i, a in enumerate(range(0, n, capacity))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Bins:
    """Open sequences by gap: gap -> ranges [lo, hi) of sequence numbers; numbers start at 0."""

    def __init__(self, capacity: int):
        self.capacity, self.next, self.ranges, self.gaps = capacity, 0, {}, []
        self.placed: list[tuple[int, int, int, int, int]] = []  # length, first rank, count, first sequence, offset
        self.ranks: dict[int, int] = {}

    def put(self, gap: int, lo: int, hi: int) -> None:
        if gap not in self.ranges:
            self.ranges[gap] = []
            insort(self.gaps, gap)
        self.ranges[gap].append((lo, hi))

    def take(self, gap: int, most: int) -> tuple[int, int]:
        """Up to `most` sequences with this gap, as one range."""
        lo, hi = self.ranges[gap].pop()
        if hi - lo > most:
            self.ranges[gap].append((lo + most, hi))
            hi = lo + most
        if not self.ranges[gap]:
            del self.ranges[gap]
            self.gaps.remove(gap)
        return lo, hi

    def place(self, length: int, lo: int, hi: int, gap: int, copies: int = 1) -> None:
        """So many pieces of this length into each of [lo, hi), whose gap was `gap`."""
        for _ in range(copies):
            rank = self.ranks.get(length, 0)
            self.placed.append((length, rank, hi - lo, lo, self.capacity - gap))
            self.ranks[length] = rank + hi - lo
            gap -= length
        self.put(gap, lo, hi)

    def open(self, length: int, n: int) -> None:
        lo, self.next = self.next, self.next + n
        self.place(length, lo, lo + n, self.capacity)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Placements (length, first rank, count, first sequence, offset) that use up the histogram."""
    bins, left = _Bins(capacity), dict(histogram)
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        first = large[-1]
        fits = bisect_left(large, capacity - first + 1) - 1  # the largest that fits beside it
        if fits < 0:
            n = left[first]
            bins.open(first, n)
        else:
            second = large[fits]
            n = min(left[first], left[second]) if first != second else left[first] // 2
            if n:
                lo = bins.next
                bins.open(first, n)
                lo, hi = _exactly(bins, capacity - first, lo, lo + n)
                bins.place(second, lo, hi, capacity - first)
                left[second] -= n
            elif first == second:  # one is left over: beside it goes the next smaller, if any
                if fits:
                    second = large[fits - 1]
                    bins.open(first, 1)
                    lo, hi = _exactly(bins, capacity - first, bins.next - 1, bins.next)
                    bins.place(second, lo, hi, capacity - first)
                    left[second] -= 1
                else:
                    bins.open(first, 1)
                n = 1
        left[first] -= n
        large = [x for x in large if left[x] > 0]
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(bins.gaps, length)
            gap = bins.gaps[at] if at < len(bins.gaps) else capacity
            copies = min(gap // length, left[length])  # sequences are filled one after the other, as many at once as come out full
            most = left[length] // copies
            if at < len(bins.gaps):
                lo, hi = bins.take(gap, most)
            else:
                lo, hi = bins.next, bins.next + most
                bins.next = hi
            bins.place(length, lo, hi, gap, copies)
            left[length] -= copies * (hi - lo)
    return np.array(bins.placed, dtype=np.int64).reshape(-1, 5)


def _exactly(bins: _Bins, gap: int, lo: int, hi: int) -> tuple[int, int]:
    """Take back the range that was put last."""
    taken = bins.take(gap, hi - lo)
    assert taken == (lo, hi)
    return taken


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    cut = materialize(pieces(docs, tokenizer, key, text, capacity, end_id))
    sizes = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most `capacity` rows
    total = sum(r["n"] for r in sizes)
    placed = plan({r["length"]: r["n"] for r in sizes}, capacity)
    placed = placed[np.lexsort((placed[:, 1], placed[:, 0]))]
    shared = docs.sparkSession.sparkContext.broadcast(placed)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        rows = shared.value
        keys = rows[:, 0] << 48 | rows[:, 1]
        hit = rows[np.searchsorted(keys, length.to_numpy() << 48 | rank.to_numpy(), side="right") - 1]
        return pd.DataFrame({"sequence_id": hit[:, 3] + rank.to_numpy() - hit[:, 1], "offset": hit[:, 4]})

    ranked = group_rank(cut, "length", ["doc_id", "piece", "ids_crc32"], spread(total), "rank")
    return ranked.withColumn("_to", place("length", "rank")).select("doc_id", "piece", "start", "length", "ids_crc32", "_to.sequence_id", "_to.offset")
