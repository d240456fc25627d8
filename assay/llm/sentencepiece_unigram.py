"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

A text's spaces become the marker U+2581 and one marker goes before it; of all ways to
write it as pieces, the one with the highest sum of log scores is taken, among equal
sums the one whose last piece starts first.  A character that is no piece by itself may
be left to byte fallback at a score of 10 below the lowest, and becomes one byte piece
for each of its UTF-8 bytes.  Decoding joins pieces and bytes, turns markers to spaces
and drops the first.  A literal U+2581 in a text is left to the byte pieces, so that
decode(encode(text)) is the text, always.

Scores: a unigram model's own; a BPE model has merge ranks instead of log scores, and
rank r then scores -log(r + 1), a Zipf weight.

Words recur.  Pieces never go on past a marker that follows another character (this is
checked when a vocabulary is read), so segments between markers are solved by
themselves, once for each worker process, and remembered up to a bound.  New segments of
a batch are solved side by side: one step follows the trie from one position of all.
Long stretches without a marker are cut between characters that stand side by side in no
piece, so that they too are solved side by side; only a run of which all neighbours are
part of some piece, one letter over and over, is followed position by position.

Defined cases: a null text is an empty one; an empty text has no ids; invalid ids raise
KeyError; bytes that are no UTF-8 decode to U+FFFD; extra columns pass through.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm.common import has_columns, text_or_empty

MARK = "▁"
FALLBACK = 10.0
#: Distinct segments whose ids a worker process remembers before it starts anew.
REMEMBERED = 400_000
#: Characters of a segment from which on it is cut wherever no piece has both neighbours, and not remembered.
LONG = 64


@dataclass(frozen=True)
class Trie:
    """A double array over UTF-8 bytes: child of node s by byte c is base[s] + c if check there is s; value: piece id or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def build(cls, keys: dict[bytes, int]) -> Trie:
        words = sorted(keys)
        size = 2_048 + 8 * sum(map(len, words))
        base, check, value, taken = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32), bytearray(size)
        taken[0] = 1
        free, top, todo = [1] * 257, 0, [(0, 0, len(words), 0)]  # free: by number of edges, where to look first; node, range of words, depth
        while todo:
            node, lo, hi, depth = todo.pop()
            if lo < hi and len(words[lo]) == depth:
                value[node] = keys[words[lo]]
                lo += 1
            edges, i = [], lo
            while i < hi:
                c, j = words[i][depth], i
                while j < hi and words[j][depth] == c:
                    j += 1
                edges.append((c, i, j))
                i = j
            if not edges:
                continue
            first, rest, tries = edges[0][0], [c - edges[0][0] for c, _, _ in edges[1:]], 0
            at = taken.find(0, max(free[len(edges)], first + 1))
            while any(taken[at + c] for c in rest):
                at, tries = taken.find(0, at + 1), tries + 1
            free[len(edges)] = max(free[len(edges)], at - 256) if tries > 32 or not rest else free[len(edges)]
            base[node] = at - first
            for c, i, j in edges:
                child = at - first + c
                taken[child], check[child], top = 1, node, max(top, child)
                todo.append((child, i, j, depth + 1))
        cut = top + 257  # every lookup stays inside
        return cls(base[:cut].copy(), check[:cut].copy(), value[:cut].copy())


class Vocabulary:
    """Pieces of a SentencePiece file with log scores, as a trie."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int]):
        """byte_ids: byte -> id of its piece; pieces that are "" (control, unknown, bytes) are not matched in text."""
        keys = {p.encode(): i for i, p in enumerate(pieces) if p}
        self.trie, self.scores, self.byte_ids = Trie.build(keys), np.array(scores, dtype=np.float64), byte_ids
        self.lowest = min((scores[i] for i in keys.values()), default=0.0)
        self.longest = max(map(len, keys), default=1)
        self.breaks = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        self.lines = not any("\n" in p for p in pieces)
        self.beside = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.bytes_of = [p.replace(MARK, " ").encode() for p in pieces]
        for byte, i in byte_ids.items():
            self.bytes_of[i] = bytes([byte])

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)]
        pieces = [model.id_to_piece(i) if plain[i] else "" for i in range(n)]
        scores = [model.get_score(i) for i in range(n)]
        # merge ranks are whole numbers, all different; log scores are not
        listed = [s for s, p in zip(scores, plain, strict=True) if p and s > -1e8]
        if all(s == int(s) for s in listed):
            scores = [-float(np.log1p(min(-s, n))) for s in scores]
        byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        return cls(pieces, scores, byte_ids)

    def viterbi(self, segments: list[bytes]) -> list[list[int]]:
        """The best pieces' ids of each segment, all segments side by side."""
        order = sorted(range(len(segments)), key=lambda i: len(segments[i]))
        out: list[list[int]] = [[]] * len(segments)
        at = 0
        while at < len(order):  # segments of like length together, so that padding stays small
            width = max(32, 2 * len(segments[order[at]]))
            end = at
            while end < len(order) and len(segments[order[end]]) <= width and end - at < max(256, (1 << 20) // width):
                end += 1
            for i, ids in zip(order[at:end], self._solve([segments[i] for i in order[at:end]]), strict=True):
                out[i] = ids
            at = end
        return out

    def _solve(self, segments: list[bytes]) -> list[list[int]]:
        trie, n = self.trie, len(segments)
        size = np.array([len(s) for s in segments])
        width = int(size.max(initial=0))
        text = np.zeros((width + 1, n), np.int32)
        lengths_mask = np.arange(width)[:, None] < size
        text[:width].T[lengths_mask.T] = np.frombuffer(b"".join(segments), np.uint8)
        best, piece, origin = np.full((width + 1, n), -np.inf), np.full((width + 1, n), -1, np.int32), np.zeros((width + 1, n), np.int32)
        best[0] = 0
        jump = np.where(text < 0x80, 1, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, 4)))
        every = np.arange(n)
        for i in range(width):
            live = every[(size > i) & (best[i] > -np.inf)]
            if not len(live):
                continue
            char, alone = jump[i, live], np.zeros(n, bool)
            start, node = best[i], np.zeros(len(live), np.int32)
            own = live
            for d in range(min(self.longest, width - i)):
                child = trie.base[node] + text[i + d, own]
                ok = (trie.check[child] == node) & (size[own] > i + d)
                own, node = own[ok], child[ok]
                if not len(own):
                    break
                value = trie.value[node]
                hit = value >= 0
                if hit.any():
                    j, v = own[hit], value[hit]
                    alone[j[jump[i, j] == d + 1]] = True
                    score = start[j] + self.scores[v]
                    better = score > best[i + d + 1, j]
                    j, v = j[better], v[better]
                    best[i + d + 1, j], piece[i + d + 1, j], origin[i + d + 1, j] = score[better], v, i
            rest = ~alone[live]
            if rest.any():
                j, to = live[rest], i + char[rest]
                score = start[j] + self.lowest - FALLBACK
                better = score > best[to, j]
                j, to = j[better], to[better]
                best[to, j], piece[to, j], origin[to, j] = score[better], -1, i
        out = []
        for k, s in enumerate(segments):
            at, ids = len(s), []
            while at:
                begin, p = int(origin[at, k]), int(piece[at, k])
                ids += [p] if p >= 0 else [self.byte_ids[b] for b in reversed(s[begin:at])]
                at = begin
            out.append(ids[::-1])
        return out

    def decode(self, ids: list[int]) -> str:
        whole = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return whole[1:] if whole.startswith(" ") else whole


class Encoder:
    """Encodes batches of texts, remembering words."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known = vocabulary, {}
        self.literal = np.array([vocabulary.byte_ids[b] for b in MARK.encode()], "<i4").tobytes()

    def _segments(self, text: str) -> list[str]:
        """Stretches that no piece goes beyond; U+2581 stands for a space, and a stretch of "" for a literal U+2581."""
        if not text:
            return []
        out = []
        for k, part in enumerate(text.split(MARK)):
            if k:
                out.append("")
            body = MARK + part.replace(" ", MARK) if not k else part.replace(" ", MARK)
            lines = body.split("\n") if self.vocabulary.lines else [body]
            for n, line in enumerate(lines):
                if n:
                    out.append("\n")
                if not line:
                    continue
                if not self.vocabulary.breaks:
                    out.append(line)
                    continue
                marks = 0
                words = line.split(MARK)
                if words[0]:
                    out.append(words[0])
                for word in words[1:]:
                    marks += 1
                    if word:
                        out.append(MARK * marks + word)
                        marks = 0
                if marks:
                    out.append(MARK * marks)
        if any(len(s) > LONG for s in out):
            return [x for s in out for x in (self._cut(s) if len(s) > LONG else (s,))]
        return out

    def _cut(self, segment: str) -> list[str]:
        """A long segment in parts: characters that stand side by side in no piece are never in one."""
        cuts = [k for k in range(1, len(segment)) if segment[k - 1 : k + 1] not in self.vocabulary.beside]
        return [segment[i:j] for i, j in zip([0, *cuts], [*cuts, len(segment)], strict=True)]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian int32."""
        for i in range(0, len(texts), 256):
            cut = [self._segments(t) for t in texts[i : i + 256]]
            new = set()
            for c in cut:
                new.update(c)
            new.difference_update(self.known)
            if len(self.known) + len(new) > REMEMBERED:
                self.known = {}
                new = {s for c in cut for s in c}
            listed = [s for s in new if s]
            solved = self.vocabulary.viterbi([s.encode("utf-8", "replace") for s in listed])
            self.known.update((s, np.array(ids, "<i4").tobytes()) for s, ids in zip(listed, solved, strict=True))
            self.known[""] = self.literal
            yield from (b"".join(map(self.known.__getitem__, c)) for c in cut)
            for s in listed:
                if len(s) > LONG:
                    del self.known[s]


@functools.cache
def encoder_for(path: str) -> Encoder:
    """One encoder for a worker process, whatever number of tasks it runs."""
    return Encoder(Vocabulary.load(path))


def encode(rows: DataFrame, model: str, text: str = "text") -> DataFrame:
    """rows with `ids`, the piece ids of text, in place of text."""
    has_columns(rows, text)
    keep = [c for c in rows.columns if c not in (text, "ids")]
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(model)
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                found = list(encoder.encode(part.column(len(keep)).to_pylist()))
                ends = np.cumsum([0, *(len(f) // 4 for f in found)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4")))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], ids], names=[*keep, "ids"])

    return rows.select(*keep, text_or_empty(text).alias("_text")).mapInArrow(run, schema)


def decode(rows: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """rows with `text`, decoded from ids, beside all columns."""
    has_columns(rows, ids)
    keep = [c for c in rows.columns if c != "text"]
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder_for(model).vocabulary
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [vocabulary.decode(x.values.to_numpy().tolist() if x.is_valid else []) for x in part.column(keep.index(ids))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*keep, "text"])

    return rows.select(*keep).mapInArrow(run, schema)
