"""Line dedup over overlapping windows of consecutive lines, in DataFrame operations only.

Lines are cut at line feeds.  Every `size` consecutive lines are a window, addressed by
the MD5 of their text.  Of a window that occurs more than once in all documents, the
first occurrence (by key, then content, then line) stays; each later one covers its
lines, and covered lines go.  A line goes only if the same line stands earlier, so no
line vanishes from all documents.

The time of a text follows its length: runs are counted off by windows over its lines.

Defined cases: a null text stays null; texts with fewer lines than a window never
change; rows with the same key and text are the same document and fare alike; null keys
sort first; windows of blank lines count like others; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assay.llm.common import has_columns, materialize

WINDOW = 3


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def windows(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(hash, doc, line): one row per window; doc is (key, text hash)."""
    has_columns(docs, key, text)
    cut = docs.where(F.col(text).isNotNull()).select(F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("body")).alias("doc"), lines(F.col(text)).alias("lines"))
    hashed = F.transform(F.sequence(F.lit(0), F.size("lines") - size), lambda i: F.unhex(F.md5(F.array_join(F.slice("lines", i + 1, size), "\n"))))
    return cut.where(F.size("lines") >= size).select("doc", F.posexplode(hashed).alias("line", "hash"))


def later_occurrences(found: DataFrame) -> DataFrame:
    """(doc, line) of windows that occur earlier in some document.

    First occurrences come from a partially aggregated minimum and are written, so that a
    very common window is joined back from two plain shuffles, which Spark splits by rows.
    """
    first = materialize(found.groupBy("hash").agg(F.min(F.struct("doc", "line")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("hash", "first"))
    return found.join(first, "hash").where(F.struct("doc", "line") != F.col("first")).select("doc", "line").distinct()


def merged(later: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc, runs array<struct<from,to>>): the runs of lines (ends exclusive) that windows at later(doc, line) cover, one row per document that has any."""
    within = Window.partitionBy("doc").orderBy("line")
    fresh = F.coalesce(F.col("line") > F.lag("line").over(within) + size, F.lit(True))
    numbered = later.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(within))
    runs = numbered.groupBy("doc", "run").agg(F.min("line").alias("from"), (F.max("line") + size).alias("to"))
    return runs.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("runs"))


def _outside(lines_of: Column, runs: Column) -> Column:
    """The lines outside the runs."""
    before = F.transform(runs, lambda r, i: F.struct(F.coalesce(F.get(runs, i - 1)["to"], F.lit(0)).alias("from"), r["from"].alias("to")))
    after = F.struct(F.try_element_at(runs, F.lit(-1))["to"].alias("from"), F.size(lines_of).alias("to"))
    return F.flatten(F.transform(F.concat(before, F.array(after)), lambda g: F.slice(lines_of, g["from"] + 1, g["to"] - g["from"])))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """docs with covered lines taken out of text, plus n_lines, n_removed and removed (runs of line numbers)."""
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed", "removed")]
    found = materialize(windows(docs, key, text, size))
    gone = merged(later_occurrences(found), size).select("doc.key", "doc.body", "runs").toDF("_key", "_body", "_found")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col(key).alias("_k"), F.xxhash64(text).alias("_b"))
    joined = rows.join(gone.hint("shuffle_hash"), F.col("_k").eqNullSafe(F.col("_key")) & (F.col("_b") == F.col("_body")), "left")
    whole = F.col("_row").getField(text)
    with_runs = joined.select("_row", F.coalesce("_found", F.array().cast("array<struct<from:int,to:int>>")).alias("_runs"), F.when(F.col("_found").isNotNull(), lines(whole)).alias("_lines"), _count(whole).alias("_n"))
    new = F.when(F.size("_runs") > 0, F.array_join(_outside(F.col("_lines"), F.col("_runs")), "\n")).otherwise(whole)
    removed = F.aggregate("_runs", F.lit(0), lambda acc, r: acc + r["to"] - r["from"])
    return with_runs.select(*[(new if c == text else F.col("_row").getField(c)).alias(c) for c in columns], F.col("_n").alias("n_lines"), removed.alias("n_removed"), F.col("_runs").alias("removed"))


def _count(text: Column) -> Column:
    return F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
