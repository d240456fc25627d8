"""SimHash near-duplicates by multi-index hashing.

Words are runs of anything but ASCII white space, after A-Z are lower-cased; a shingle
is `width` words joined by spaces (a shorter text is one shingle; a text without words
has fingerprint zero).  A fingerprint bit is 1 if it is set in over half of the
shingles' XXH64 hashes, repeats included.  Fingerprints link at 2 or fewer differing
bits, and a component is what links reach.

The index cuts a fingerprint into two 32-bit segments.  Of two bits that differ, one
segment holds at most one, so each fingerprint looks up, in each segment's table, its
own segment value and the values one bit away (only by clearing a set bit: of two values
one bit apart, one has the bit set).  Matches are verified on all 64 bits.

A bucket with many fingerprints would give all their pairs.  Fingerprints that reach a
bucket of over `bucket` entries are therefore also linked through whole-fingerprint
balls: each lists itself and its 64 neighbours, and those that list one point are
within two bits of each other, so a star to the least of them is exact.  A point is
listed by at most 65 distinct fingerprints.

Defined cases: null text is an empty text; empty texts link to each other; equal
fingerprints are one entry however many rows have them; a null key is never a
component's id unless all its keys are null; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.common import components, has_columns, materialize, text_or_empty

SEED = 42
BUCKET = 64
_CHUNK = 1 << 15


def fingerprint(text: str, width: int = 3) -> int:
    """The 64-bit fingerprint of one text, unsigned."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, ones, digest = len(words) - width + 1, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    starts, ends = starts[:n].tolist(), ends[width - 1 :].tolist()
    for i in range(0, n, _CHUNK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + _CHUNK], ends[i : i + _CHUNK], strict=True)], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp long) for every row."""
    has_columns(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t or "", width) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _segment(value, number: int):
    """A segment as a table key: the segment's number above its 32 bits."""
    return F.shiftrightunsigned(value, 32 * number).bitwiseAND(F.lit(0xFFFFFFFF)) + F.lit(number << 32)


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): enough of the links between distinct fingerprints (column fp) that components are exact."""
    own = prints.select("fp", F.explode(F.array(_segment(F.col("fp"), 0), _segment(F.col("fp"), 1))).alias("seg"))
    table = own.groupBy("seg").agg(F.count(F.lit(1)).alias("entries"), F.min("fp").alias("only"))
    bits = F.transform(F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.getbit("seg", i) == 1), lambda i: F.col("seg") - F.call_function("shiftleft", F.lit(1).cast("long"), i))
    probes = own.select("fp", F.explode(F.concat(F.array("seg"), bits)).alias("seg"))
    hits = materialize(probes.join(table.hint("shuffle_hash"), "seg").where("entries > 1 OR only != fp"))

    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= 2
    single = hits.where("entries = 1").select(F.col("fp").alias("a"), F.col("only").alias("b"))
    some = hits.where(F.col("entries").between(2, bucket)).select("seg", F.col("fp").alias("a"))
    pairs = single.unionByName(some.join(own.select("seg", F.col("fp").alias("b")), "seg").select("a", "b")).where(near("a", "b") & (F.col("a") != F.col("b")))

    crowded = hits.where(F.col("entries") > bucket).select("fp").distinct()
    around = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    points = crowded.select("fp", F.explode(F.concat(F.array("fp"), around)).alias("point"))
    stars = points.groupBy("point").agg(F.min("fp").alias("b"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    starred = stars.select(F.explode("all").alias("a"), "b").where("a != b")
    return pairs.unionByName(starred).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest key reachable."""
    rows = materialize(fingerprints(docs, key, text, width))
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(prints))
    labelled = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    found = materialize(labelled.join(least, "root").select("fp", "component_id"))
    return rows.join(found, "fp").select("doc_id", "fp", "component_id")


PLACE = "struct<nokey:boolean,key:long,body:long>"


def place(key: str, text: str) -> Column:
    return F.struct(F.col(key).isNull().alias("nokey"), F.coalesce(F.col(key).cast("long"), F.lit(-1)).alias("key"), F.xxhash64(text_or_empty(text)).alias("body"))


def rows_at(docs: DataFrame, places: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """places (column place, distinct) with _row: one row of docs for each; rows of one key and text are the same document."""
    keys = ["nokey", "key", "body"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), place(key, text).alias("_place")).select("_row", *[F.col(f"_place.{k}").alias(k) for k in keys])
    return rows.join(places.select(*[c for c in places.columns if c != "place"], "place.*"), keys).dropDuplicates(keys).drop(*keys)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """docs with one row of each component: that of the smallest key, null keys last, then of the least text hash.

    Components are those of near_duplicates, joined where near_copies finds texts alike.
    """
    from assay.llm import near_copies

    marked = materialize(near_copies.marks(docs, key, text, width))
    prints = materialize(marked.groupBy("fp").agg(F.min("place").alias("place")))
    roots = near_copies.joined(docs, marked, links(prints), key, text)
    rooted = prints.join(roots, prints["fp"] == roots["node"], "left").select("place", F.coalesce("root", "fp").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("place").alias("place")).select("place")
    return rows_at(docs, materialize(kept), key, text).select("_row.*")
