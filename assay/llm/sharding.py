"""Proportional stratified interleaving into shards, in DataFrame operations only.

Within each source the rows are put in a seeded-shuffled order; a row of rank r of n has
the fractional rank (r + u) / n, where u is a number from 0 to 1 that the seed draws for
the source.  All rows in the order of fractional rank carry every source at its share of
the whole in every stretch, and sources of few rows, which no stretch can have a share of,
are spread evenly together; so equal cuts of that order are shards with the mixture of the
whole.  Shard sizes differ by one row at most.

No window spans a source or the whole: ranks are taken in cells whose number grows with
the rows, and cell offsets come from counts.  Rows that are repeated more often than a
cell is meant to hold are dealt numbers, so that they too fall into many cells.

Defined cases: a null source is a source of its own; the shuffle's draw is made from
seed, key, size and checksum; ties are ordered by key, then checksum, and repeated rows
are interchangeable; null text has size 16 and
checksum 0; with fewer rows than shards, some shards are empty; extra columns that are
not asked for are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assay.llm.common import CELL_ROWS, group_rank, has_columns, materialize, spread, text_or_empty

SHARDS = 40
SEED = "shard-1"


def describe(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, size, text_crc32, source): what sharding needs of each row."""
    has_columns(docs, key, text, source)
    body = text_or_empty(text).cast("binary")
    return docs.select(F.col(key).alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.col(source).alias("source"))


def phase(seed: str) -> Column:
    """Where in its stretches a source has its rows, from 0 to 1; 52 bits of a digest."""
    named = F.concat_ws(":", F.lit(seed), F.when(F.col("source").isNull(), "null").otherwise("of"), F.col("source").cast("string"))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def draw(seed: str) -> Column:
    """The place of a row in the shuffle, as 32 hex digits; _copy tells very often repeated rows apart."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in ("doc_id", "size", "text_crc32", "_copy")]).cast("binary"))


def _numbered(rows: DataFrame, often: int = CELL_ROWS) -> DataFrame:
    """written rows with _copy: null, but for rows repeated more than `often` times a number of which few of them have the same."""
    same = ["doc_id", "size", "text_crc32", "source"]
    repeated = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > often)  # rows / `often` at most
    named = repeated.select(*[F.col(c).alias(f"_{c}") for c in same], "_n")
    equal = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same])
    found = rows.withColumn("_at", F.monotonically_increasing_id()).join(F.broadcast(named), equal, "left")
    copy = F.when(F.col("_n").isNotNull(), F.pmod(F.xxhash64("_at"), F.ceil(F.col("_n") / 100)))
    return found.select(*rows.columns, copy.alias("_copy"))


def interleave(rows: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """rows (as describe() makes them) with shard and slot; slots of a shard are gapless from 0."""
    rows = materialize(rows)
    n = rows.count()
    cells = spread(n)
    shuffled = materialize(_numbered(rows).withColumn("_shuffle", draw(seed)).drop("_copy"))
    cell = F.floor(F.conv(F.substring("_shuffle", 1, 8), 16, 10).cast("double") / 2**32 * cells)  # in the order of the draw
    ranked = group_rank(shuffled, "source", ["_shuffle", "doc_id", "text_crc32"], cells, "_rank", cell)
    placed = ranked.withColumn("_at", (F.col("_rank") + phase(seed)) / F.col("_rank_of")).withColumn("_band", F.least(F.floor(F.col("_at") * cells), F.lit(cells - 1)).cast("int"))
    placed = materialize(placed.drop("_rank", "_rank_of"))
    bands = placed.groupBy("_band").agg(F.count(F.lit(1)).alias("_n"))
    before = bands.select("_band", (F.sum("_n").over(Window.orderBy("_band")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_band").orderBy("_at", "source", "_shuffle", "doc_id", "text_crc32")) - 1
    position = placed.withColumn("_p", within).join(F.broadcast(before), "_band").withColumn("_p", (F.col("_p") + F.col("_before")).cast("long"))  # a row a cell: rows / 50,000
    shard = F.expr(f"_p * {shards} div {max(n, 1)}").cast("int")
    first = F.expr(f"(shard * {max(n, 1)}L + {shards - 1}) div {shards}")
    return position.withColumn("shard", shard).withColumn("slot", (F.col("_p") - first).cast("long")).select("doc_id", "size", "text_crc32", "source", "shard", "slot")
