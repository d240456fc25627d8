"""Alignment of two tokenizers over a corpus, by id-striped dense count matrices.

A text is encoded by A, a byte-level BPE, with a space put before it, and by B, a
SentencePiece BPE, which puts that space itself.  Tokens stand for bytes; where a token of
A and one of B both end, a group ends; tokens whose bytes overlap are linked.  The count
of an (A id, B id) pair is the number of links in the corpus that hold it, and a pair is
best if its B id has no pair with a higher count.

align() encodes every text once and is written.  It yields the row of each document, the
links of its batch and the counts of its task, links and counts in blocks by stripe: a
stripe is all B ids of one remainder, so frequent ids (low numbers in a BPE vocabulary)
are spread.  Counts of a stripe meet in one dense matrix, ids of B by ids of A, into which
np.add.at puts each block; only one matrix is held at a time, however many blocks pass.
Links go to the tasks of their stripe, behind the counts: these fill the matrix again, row
maxima tell the best pairs, and the links that stream by are scored.  A stripe with more
links than others is dealt to several groups, each of which gets its counts.

Words are encoded once.  Both tokenizers end a token between a visible character and a
space or line break (held against the vocabulary of B when it is read), so a word with the
white space before it is aligned by itself; what words gave is remembered up to a bound in
bytes.  Long runs without white space are cut between two characters that no token of
either vocabulary has side by side, long texts between words; only a run of which every
pair of neighbours is part of some token is held as a whole.

Defined cases: texts that are null, empty, or not given back by both tokenizers (U+2581
becomes a space) have no tokens and count nowhere: zeros and an empty string; every row is
counted, repeated rows too; a null key is kept; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import has_columns, materialize, text_or_empty

STRIPES = 128
#: Characters that are aligned together, and of a long text that are held at once.
TOGETHER = 1 << 21
#: Characters of a run without white space from which on it is cut.
LONG_RUN = 4096
#: Bytes of words that a worker process remembers, about.
REMEMBERED = 96 << 20
#: Pairs with counts that a task holds before it passes them on.
COUNTED = 1 << 21
#: Links that one group of a stripe scores at most, about.
GROUP_LINKS = 32 << 20
#: Blocks of counts that meet in one task.
MEETING = 4096
MARK = "▁"

DOCUMENT, LINKS, COUNTS = 0, 1, 2
SCHEMA = "kind int, row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, stripe int, entries long, block binary"


def _byte_of_sign() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable bytes for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """A and B, and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        sign, vocabulary = _byte_of_sign(), self.a.get_vocab(with_added_tokens=False)
        with open(path_a) as f:
            added = {x["id"]: x["content"].encode() for x in json.load(f).get("added_tokens", [])}
        bytes_a = added | {i: bytes(map(sign.__getitem__, piece)) for piece, i in vocabulary.items()}
        with open(path_b, "rb") as f:
            model = f.read()
        # a message that is repeated is merged: normalizer_spec { add_dummy_prefix: false }
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model + b"\x1a\x02\x18\x00")
        bytes_b, pieces = {}, []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                bytes_b[i] = bytes([int(piece[1:-1], 16)])
            else:
                bytes_b[i] = piece.replace(MARK, " ").encode()
                if not (self.b.is_control(i) or self.b.is_unknown(i)):
                    pieces.append(piece.replace(MARK, " "))
        self.bytes_a = [bytes_a.get(i, b"") for i in range(max(bytes_a, default=0) + 1)]
        self.bytes_b = [bytes_b[i] for i in range(len(bytes_b))]
        self.len_a, self.len_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        self.beside_a = {x[i : i + 2] for x in self.bytes_a for i in range(len(x) - 1)}
        self.beside_b = {x[i : i + 2] for x in pieces for i in range(len(x) - 1)}
        crossed = {x[1] for x in self.beside_b if not x[0].isspace()}
        self.breaks = "".join(c for c in " \n" if c not in crossed)
        self._odd = re.compile(rf"[^\S{re.escape(self.breaks)}]")
        self.stops = "".join(c for c in ",." if not any(x[0].isalnum() and x[1] == c for x in self.beside_b) and not any(x[1] == ord(c) and (x[0] > 127 or chr(x[0]).isalnum()) for x in self.beside_a))
        self._words = re.compile(rf"\s*[^\W_]+(?=[{re.escape(self.stops)}])|\s*\S+|\s+" if self.stops else r"\s*\S+|\s+")

    def words(self, text: str) -> list[str]:
        """text, cut where both tokenizers end a token whatever stands around."""
        found = self._words.findall(text)
        if self._odd.search(text):  # white space before which a token may go on
            out: list[str] = []
            for w in found:
                if out and w[0] not in self.breaks:
                    out[-1] += w
                else:
                    out.append(w)
            found = out
        if any(len(w) > LONG_RUN for w in found):
            found = [x for w in found for x in (self._cut(w) if len(w) > LONG_RUN else (w,))]
        return found

    def _apart(self, text: str, k: int) -> bool:
        """Whether no token of either holds the characters before and at k side by side, and the pattern of A reads on at k as before."""
        c, d = text[k - 1], text[k]
        return d != "'" and not c.isspace() and not d.isspace() and c + d not in self.beside_b and c.encode()[-1:] + d.encode()[:1] not in self.beside_a

    def _cut(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > LONG_RUN:
            at = next((k for k in range(start + LONG_RUN, start, -1) if self._apart(text, k)), None) or next((k for k in range(start + LONG_RUN + 1, len(text)) if self._apart(text, k)), None)
            if at is None:
                break
            yield text[start:at]
            start = at
        yield text[start:]

    def pieces(self, text: str) -> Iterator[str]:
        """text in pieces of about TOGETHER characters, cut between words."""
        start, cut = 0, re.compile(rf"(?<=\S)(?=[{re.escape(self.breaks)}])") if self.breaks else None
        while cut and len(text) - start > TOGETHER:
            found = cut.search(text, start + TOGETHER)
            if not found:
                break
            yield text[start : found.start()]
            start = found.start()
        yield text[start:]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64), np.array(self.b.encode(text), np.int64)

    def same(self, text: str, a: np.ndarray, b: np.ndarray) -> bool:
        want = text.encode()
        return b"".join(map(self.bytes_a.__getitem__, a.tolist())) == want and b"".join(map(self.bytes_b.__getitem__, b.tolist())) == want


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the tokens of A and of B whose bytes overlap, by their ends, in order."""
    starts_a, starts_b = (np.concatenate(([0], e[:-1])) if len(e) else e for e in (ends_a, ends_b))
    first = np.searchsorted(ends_b, starts_a, "right")
    n = np.searchsorted(starts_b, ends_a, "left") - first
    left = np.repeat(np.arange(len(ends_a)), n)
    return left, np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


class Growing:
    """Rows that are added to, in an array with room to spare."""

    def __init__(self, *shape: int):
        self.room, self.n = np.zeros((1024, *shape), np.int64), 0

    def add(self, rows: np.ndarray) -> None:
        n = self.n + len(rows)
        if n > len(self.room):
            room = np.zeros((2 * n, *self.room.shape[1:]), np.int64)
            room[: self.n] = self.room[: self.n]
            self.room = room
        self.room[self.n : n] = rows
        self.n = n


class WordTable:
    """Words that have been aligned: their numbers of tokens, groups as text, and links as codes."""

    def __init__(self, tokenizers: Tokenizers, code):
        self.tokenizers, self.code = tokenizers, code
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.bad: set[int] = set()
        self.size = 0
        self._counts = Growing(5)  # n_a, n_b, n_groups, n_links of each word, and where its links begin
        self._codes = Growing()

    def learn(self, words: Iterable[str]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self.number]
        breaks, stops = self.tokenizers.breaks, self.tokenizers.stops
        together: list[str] = []
        groups, length = [together], 0
        for w in new:
            if MARK in w:
                self._add([w], None)
                continue
            last = together[-1][-1] if together else " "
            follows = w[0] in breaks and not last.isspace() or w[0] in stops and last.isalnum()
            if not follows or length > 1 << 16:
                together, length = [], 0
                groups.append(together)
            together.append(w)
            length += len(w)
        done: list[tuple] = []
        for words in groups:
            self._encode(words, done)
        if done:
            self._add([w for x in done for w in x[0]], tuple(np.concatenate([x[i] for x in done]) for i in (1, 2)))

    def _encode(self, words: list[str], done: list[tuple]) -> None:
        """Encode words as one text, to be cut where they end."""
        if not words:
            return
        text = "".join(words)
        a, b = self.tokenizers.encode(text)
        if self.tokenizers.same(text, a, b):
            done.append((words, a, b))
        elif len(words) > 1:
            for w in words:
                self._encode([w], done)
        else:
            self._add(words, None)

    def _add(self, words: list[str], encoded: tuple[np.ndarray, np.ndarray] | None) -> None:
        first, n = len(self.groups), len(words)
        self.number.update(zip(words, range(first, first + n), strict=True))
        if encoded is None:
            self.bad.update(range(first, first + n))
            self.groups.extend([""] * n)
            self._counts.add(np.zeros((n, 5), np.int64))
            self.size += sum(map(len, words)) + 200 * n
            return
        a, b = encoded
        ends_a, ends_b = np.cumsum(self.tokenizers.len_a[a]), np.cumsum(self.tokenizers.len_b[b])
        ends = np.cumsum([len(w.encode()) for w in words])
        left, right = overlaps(ends_a, ends_b)
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        per_word = lambda at, side="right": np.diff(np.searchsorted(at, ends, side), prepend=0)
        n_links = per_word(ends_a[left])
        counts = np.stack([per_word(ends_a), per_word(ends_b), per_word(cuts), n_links, self._codes.n + np.cumsum(n_links) - n_links], axis=1)
        to_a, to_b = np.searchsorted(ends_a, cuts, "right").tolist(), np.searchsorted(ends_b, cuts, "right").tolist()
        text_a, text_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        groups, i, j = [], 0, 0
        for k, m in zip(to_a, to_b, strict=True):
            groups.append(f"{text_a[i]}|{text_b[j]}" if k - i == m - j == 1 else f"{','.join(text_a[i:k])}|{','.join(text_b[j:m])}")
            i, j = k, m
        at = 0
        for k in counts[:, 2].tolist():
            self.groups.append(";".join(groups[at : at + k]))
            at += k
        self._counts.add(counts)
        self._codes.add(self.code(a[left], b[right]))
        self.size += sum(map(len, words)) + sum(map(len, self.groups[first:])) + 250 * n + 8 * len(left)

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """n_a, n_b, n_groups and n_links of all these words together."""
        return self._counts.room[ids, :4].sum(axis=0)

    def links(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many links each of the words has, and their codes in a row."""
        n, begin = self._counts.room[ids, 3], self._counts.room[ids, 4]
        return n, self._codes.room[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - begin, n)]


class Codes:
    """Pairs of ids as numbers, those of one stripe side by side: (stripe, row of its matrix, id of A)."""

    def __init__(self, n_a: int, n_b: int, stripes: int):
        self.n_a, self.stripes, self.rows = n_a, stripes, -(-n_b // stripes)
        self.per_stripe = self.rows * n_a

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (b % self.stripes) * self.per_stripe + (b // self.stripes) * self.n_a + a



class Matrix:
    """The counts of one stripe: a row for each id of B, a column for each of A.  Memory is taken up where something is counted."""

    def __init__(self, codes: Codes):
        self.n_a, self.cells, self.used = codes.n_a, np.zeros(codes.per_stripe, np.int64), np.zeros(codes.rows, bool)

    def add(self, block: bytes) -> None:
        pairs, counts = unpacked(block, 2)
        np.add.at(self.cells, pairs, counts)
        self.used[pairs // self.n_a] = True

    def most(self) -> np.ndarray:
        """The highest count of each row."""
        rows, out = self.cells.reshape(-1, self.n_a), np.zeros(len(self.used), np.int64)
        for i in np.flatnonzero(self.used):
            out[i] = rows[i].max()
        return out

    def counted(self) -> np.ndarray:
        """The pairs that have counts."""
        rows = self.cells.reshape(-1, self.n_a)
        return np.concatenate([np.zeros(0, np.int64), *(np.flatnonzero(rows[i]) + i * self.n_a for i in np.flatnonzero(self.used))])


def packed(*columns: np.ndarray) -> bytes:
    """Columns of unsigned numbers as one block: byte planes, compressed."""
    n = len(columns[0])
    planes, widths = [], []
    for c in columns:
        width = max(1, -(-int(c.max(initial=0)).bit_length() // 8))
        widths.append(width)
        planes.append(np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width].T).tobytes())
    raw = b"".join(planes)
    head = np.array([n, len(raw), *widths], "<u8").tobytes()
    return head + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unpacked(block: bytes, columns: int) -> list[np.ndarray]:
    n, size, *widths = np.frombuffer(block, "<u8", 2 + columns).tolist()
    raw = np.frombuffer(pa.Codec("zstd").decompress(block[8 * (2 + columns) :], size), np.uint8)
    out, at = [], 0
    for width in widths:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = raw[at : at + n * width].reshape(width, n).T
        out.append(wide.view("<i8").reshape(n))
        at += n * width
    return out


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


class Blocks:
    """Rows of SCHEMA out of one task: documents, links and counts."""

    def __init__(self, codes: Codes, base: int):
        self.codes, self.next = codes, base
        self.rows: list[dict] = []
        self.seen = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def document(self, key, found, groups: str) -> int:
        row, self.next = self.next, self.next + 1
        n = dict(zip(("n_a", "n_b", "n_groups", "n_links"), map(int, found), strict=True))
        self.rows.append({"kind": DOCUMENT, "row": row, "doc_id": key, "groups_sha256": groups} | n)
        return row

    def _by_stripe(self, kind: int, row: int | None, codes: np.ndarray, *more: np.ndarray) -> None:
        """codes are in order of stripes."""
        stripe = codes // self.codes.per_stripe
        first = np.flatnonzero(np.diff(stripe, prepend=-1))
        for i, j in zip(first, np.append(first[1:], len(codes)), strict=True):
            block = packed(codes[i:j] - stripe[i] * self.codes.per_stripe, *(m[i:j] for m in more))
            self.rows.append({"kind": kind, "row": row, "stripe": int(stripe[i]), "entries": int(j - i), "block": block})

    def links(self, table: WordTable, owners: list[int], ids: list[np.ndarray]) -> None:
        """The links of word ids; owners: the row of each array, in rising order."""
        if not owners:
            return
        base = owners[0]
        docs = np.repeat(np.array(owners, np.int64) - base, [len(x) for x in ids])
        n, pairs = table.links(np.concatenate(ids))
        docs = np.repeat(docs, n)
        if not len(pairs):
            return
        width = int(docs[-1]) + 1
        stripe, rest = np.divmod(pairs, self.codes.per_stripe)
        keys, times = np.unique((stripe * width + docs) * self.codes.per_stripe + rest, return_counts=True)
        high, rest = np.divmod(keys, self.codes.per_stripe)
        stripe, docs = np.divmod(high, width)
        pairs = stripe * self.codes.per_stripe + rest
        self._by_stripe(LINKS, base, pairs, docs, times)
        self.count(pairs, times)

    def count(self, codes: np.ndarray, times: np.ndarray) -> None:
        if len(self.seen[0]) + len(codes) > 2 * COUNTED:
            self.counted()
        codes, times = _summed(codes, times)
        self.seen = list(_summed(np.concatenate((self.seen[0], codes)), np.concatenate((self.seen[1], times))))
        if len(self.seen[0]) > COUNTED:
            self.counted()

    def counted(self) -> None:
        if len(self.seen[0]):
            self._by_stripe(COUNTS, None, *self.seen)
            self.seen = [x[:0] for x in self.seen]

    def batch(self) -> pa.RecordBatch:
        fields = [pa.field(n, {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in SCHEMA.split(", "))]
        out = pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in self.rows], f.type) for f in fields], schema=pa.schema(fields))
        self.rows = []
        return out


class Documents:
    """Aligns texts, many at a time."""

    def __init__(self, table: WordTable, out: Blocks):
        self.table, self.out = table, out
        self.waiting: list[tuple] = []  # keys and texts
        self.length = 0

    def add(self, key, text: str) -> None:
        text = " " + text if text else ""
        if not text or MARK in text:
            self.out.document(key, (0, 0, 0, 0), "")
        elif len(text) > TOGETHER:
            self.flush()
            self._long(key, text)
        else:
            self.waiting.append((key, text))
            self.length += len(text)
            if self.length > TOGETHER:
                self.flush()

    def _learnt(self, texts: list[str]) -> list[np.ndarray]:
        """The words of each text."""
        if self.table.size > REMEMBERED:
            self.table.forget()
        words = [self.table.tokenizers.words(t) for t in texts]
        self.table.learn(w for x in words for w in x)
        return [np.fromiter(map(self.table.number.__getitem__, x), np.int64, len(x)) for x in words]

    def _good(self, ids: np.ndarray) -> bool:
        return not self.table.bad or self.table.bad.isdisjoint(ids.tolist())

    def _groups(self, ids: np.ndarray) -> bytes:
        return ";".join(map(self.table.groups.__getitem__, ids.tolist())).encode()

    def flush(self) -> None:
        owners, linked = [], []
        for (key, _), ids in zip(self.waiting, self._learnt([t for _, t in self.waiting]), strict=True):
            if self._good(ids):
                owners.append(self.out.document(key, self.table.counts(ids), hashlib.sha256(self._groups(ids)).hexdigest()))
                linked.append(ids)
            else:
                self.out.document(key, (0, 0, 0, 0), "")
        self.waiting, self.length = [], 0
        self.out.links(self.table, owners, linked)

    def _long(self, key, text: str) -> None:
        """A text by pieces; twice over, as what counts nowhere must not be handed on."""
        if not all(self._good(self._learnt([piece])[0]) for piece in self.table.tokenizers.pieces(text)):
            self.out.document(key, (0, 0, 0, 0), "")
            return
        total, digest, row = np.zeros(4, np.int64), hashlib.sha256(), self.out.next
        for number, piece in enumerate(self.table.tokenizers.pieces(text)):
            ids = self._learnt([piece])[0]
            digest.update((b";" if number else b"") + self._groups(ids))
            total += self.table.counts(ids)
            self.out.links(self.table, [row], [ids])
        self.out.document(key, total, digest.hexdigest())


_tables: dict[tuple, WordTable] = {}


def word_table(path_a: str, path_b: str, stripes: int) -> WordTable:
    """The words that this worker process knows, from earlier tasks too."""
    key = path_a, path_b, stripes
    if key not in _tables:
        _tables.clear()
        known = Tokenizers(path_a, path_b)
        _tables[key] = WordTable(known, Codes(len(known.bytes_a), len(known.bytes_b), stripes))
    return _tables[key]


def align(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", stripes: int = STRIPES) -> DataFrame:
    """Rows of SCHEMA: documents, links and counts.  Rows are numbered by task, so it is written before anything is joined."""
    has_columns(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(path_a, path_b, stripes)
        out = Blocks(table.code, TaskContext.get().partitionId() << 40)
        documents = Documents(table, out)
        for batch in batches:
            for i in range(batch.num_rows):
                documents.add(batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                if len(out.rows) > 10_000:
                    yield out.batch()
            documents.flush()
            yield out.batch()
        out.counted()
        yield out.batch()

    return docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(run, SCHEMA)


def _streams(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def totals(counts: DataFrame, codes: Codes) -> DataFrame:
    """(stripe, row null, block): the counts of every pair of a stripe, each pair in one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, now = None, None

        def done() -> Iterator[pa.RecordBatch]:
            at = matrix.counted()
            blocks = [packed(at[i : i + COUNTED], matrix.cells[at[i : i + COUNTED]]) for i in range(0, len(at), COUNTED)]
            yield pa.RecordBatch.from_pydict({"part": pa.array([now[1]] * len(blocks), pa.int32()), "stripe": pa.array([now[0]] * len(blocks), pa.int32()), "block": pa.array(blocks, pa.binary())})

        for stripe, part, block in _streams(batches, "stripe", "part", "block"):
            if (stripe, part) != now:
                if now is not None:
                    yield from done()
                matrix, now = Matrix(codes), (stripe, part)
            matrix.add(block)
        if now is not None:
            yield from done()

    def meet(df: DataFrame, parts: int) -> DataFrame:
        keyed = df.select("stripe", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("part"), "block")
        return keyed.repartition("stripe", "part").sortWithinPartitions("stripe", "part").mapInArrow(run, "part int, stripe int, block binary")

    parts = -(-counts.count() // (codes.stripes * MEETING))
    return meet(meet(counts, parts) if parts > 1 else counts, 1).select("stripe", "block")


def scored(raw: DataFrame, codes: Codes) -> DataFrame:
    """(row, n_best, count_sum) in parts: links of raw against the counts of their stripe."""
    size = {r["stripe"]: r["n"] for r in raw.where(f"kind = {LINKS}").groupBy("stripe").agg(F.sum("entries").alias("n")).collect()}  # one row a stripe
    mean = max(1, -(-sum(size.values()) // codes.stripes))
    groups = F.array(*[F.lit(max(1, -(-size.get(s, 0) // min(mean, GROUP_LINKS)))) for s in range(codes.stripes)])
    n = F.element_at(groups, F.col("stripe") + 1)
    counted = totals(raw.where(f"kind = {COUNTS}"), codes).select("stripe", F.explode(F.sequence(F.lit(0), n - 1)).alias("part"), F.lit(None).cast("long").alias("row"), "block")
    links = raw.where(f"kind = {LINKS}").select("stripe", F.pmod(F.xxhash64("row", "stripe"), n).cast("int").alias("part"), "row", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, best, now = None, None, None
        for stripe, part, row, block in _streams(batches, "stripe", "part", "row", "block"):
            if (stripe, part) != now:
                matrix, best, now = Matrix(codes), None, (stripe, part)
            if row is None:
                matrix.add(block)
                continue
            if best is None:
                best = matrix.most()
            pairs, docs, times = unpacked(block, 3)
            count = matrix.cells[pairs]
            first = np.flatnonzero(np.diff(docs, prepend=-1))
            yield pa.RecordBatch.from_arrays([pa.array(docs[first] + row), pa.array(np.add.reduceat(times * (count == best[pairs // codes.n_a]), first)), pa.array(np.add.reduceat(times * count, first))], names=["row", "n_best", "count_sum"])

    both = counted.unionByName(links).repartition("stripe", "part").sortWithinPartitions("stripe", "part", F.col("row").asc_nulls_first())
    return both.mapInArrow(run, "row long, n_best long, count_sum long")


def alignment(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", stripes: int = STRIPES) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    raw = materialize(align(docs, path_a, path_b, key, text, stripes))
    known = Tokenizers(path_a, path_b)
    codes = Codes(len(known.bytes_a), len(known.bytes_b), stripes)
    sums = scored(raw, codes).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    rows = raw.where(f"kind = {DOCUMENT}").join(sums, "row", "left")
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def pair_counts(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", stripes: int = STRIPES) -> DataFrame:
    """(b, a, n, best) for every pair of ids that is linked somewhere."""
    raw = materialize(align(docs, path_a, path_b, key, text, stripes))
    known = Tokenizers(path_a, path_b)
    codes = Codes(len(known.bytes_a), len(known.bytes_b), stripes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stripe, block in _streams(batches, "stripe", "block"):
            pairs, n = unpacked(block, 2)
            b, a = np.divmod(pairs, codes.n_a)
            yield pa.RecordBatch.from_arrays([pa.array(b * codes.stripes + stripe), pa.array(a), pa.array(n)], names=["b", "a", "n"])

    found = totals(raw.where(f"kind = {COUNTS}"), codes).mapInArrow(run, "b long, a long, n long")
    most = found.groupBy("b").agg(F.max("n").alias("most"))
    return found.join(most, "b").select("b", "a", "n", (F.col("n") == F.col("most")).alias("best"))
