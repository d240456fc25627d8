"""Payloads from files, from tables and from lists of bytes; sanitised files back out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.sources.listing import list_files

PAYLOAD = "payload_id string, filename string, content_type string, size long, oversized boolean, content binary"


class UnsupportedSource(TypeError):
    pass


def from_files(spark: SparkSession, paths: str | list[str], max_size: int | None = None, empty_files: bool = True) -> DataFrame:
    """Payloads of files: the path is the id, its last part the name.

    Files over max_size are listed with their size but never read.  Spark's reader leaves
    out files of no bytes; these are added from a listing by tasks, which needs a store
    that Arrow reaches.  For files too large for one value: plans.guard.scan_files().
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    name = F.substring_index("path", "/", -1)  # Spark's reader does not encode paths
    kept = files if max_size is None else files.where(F.col("length") <= max_size)
    read = kept.select(F.col("path").alias("payload_id"), name.alias("filename"), F.lit(None).cast("string").alias("content_type"), F.col("length").alias("size"), F.lit(False).alias("oversized"), "content")
    if max_size is not None:
        large = files.where(F.col("length") > max_size)
        read = read.unionByName(large.select(F.col("path").alias("payload_id"), name.alias("filename"), F.lit(None).cast("string").alias("content_type"), F.col("length").alias("size"), F.lit(True).alias("oversized"), F.lit(b"").alias("content")))
    if not empty_files:
        return read
    return read.unionByName(_empty_files(spark, [paths] if isinstance(paths, str) else list(paths)))


def _empty_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Payloads of files without bytes.  The driver works out the patterns in paths, tasks list what they name."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    roots = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        roots += [_uri(status.getPath().toString()) for status in path.getFileSystem(conf).globStatus(path) or []]
    if not roots:
        return spark.createDataFrame([], PAYLOAD)
    path = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    path = F.when(path.startswith("file:///"), F.concat(F.lit("file:"), F.substring(path, 8, 1 << 30))).otherwise(path)  # as Spark's reader writes it
    files = list_files(spark, roots).where("size = 0").withColumn("path", path)
    return files.select(F.col("path").alias("payload_id"), F.substring_index("path", "/", -1).alias("filename"), F.lit(None).cast("string").alias("content_type"), "size", F.lit(False).alias("oversized"), F.lit(b"").alias("content"))


def _uri(path: str) -> str:
    """file:/x, as Hadoop writes it, is file:///x elsewhere."""
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path


def from_table(rows: DataFrame, content: str | Column, payload_id: str | Column, filename: str | Column | None = None, content_type: str | Column | None = None, size: str | Column | None = None, max_size: int | None = None) -> DataFrame:
    """Payloads from columns of any table."""
    column = lambda c, t: F.lit(None).cast(t) if c is None else (F.col(c) if isinstance(c, str) else c).cast(t)
    body = column(content, "binary")
    n = F.coalesce(column(size, "long"), F.octet_length(body).cast("long"))
    oversized = F.lit(False) if max_size is None else n > max_size
    return rows.select(column(payload_id, "string").alias("payload_id"), column(filename, "string").alias("filename"), column(content_type, "string").alias("content_type"), n.alias("size"), oversized.alias("oversized"), F.when(~oversized, body).otherwise(F.lit(b"")).alias("content"))


def from_bytes(spark: SparkSession, items: list[tuple[str, bytes]] | dict[str, bytes]) -> DataFrame:
    """Payloads from (filename, bytes) pairs; numbered from 0."""
    pairs = list(items.items()) if isinstance(items, dict) else list(items)
    return spark.createDataFrame([(str(i), n, None, len(b), False, bytearray(b)) for i, (n, b) in enumerate(pairs)], PAYLOAD)


def read_payloads(spark: SparkSession, source, **options) -> DataFrame:
    """Payloads of whatever source is: a path or paths, a table with its columns named, bytes, or (name, bytes) pairs."""
    if isinstance(source, DataFrame):
        return from_table(source, **options)
    if isinstance(source, (bytes, bytearray, memoryview)):
        return from_bytes(spark, [(options.get("filename"), bytes(source))])
    if isinstance(source, str):
        return from_files(spark, source, **options)
    if isinstance(source, dict) or (isinstance(source, list) and source and isinstance(source[0], tuple)):
        return from_bytes(spark, source)
    if isinstance(source, list) and all(isinstance(s, str) for s in source):
        return from_files(spark, source, **options)
    raise UnsupportedSource(f"cannot read payloads from {type(source).__name__}")


def head(content: Column, n: int) -> Column:
    return F.substring(content, 1, n)


def read_at(content: Column, offset: int, n: int) -> Column:
    return F.substring(content, offset + 1, n)


def read_capped(content: Column, cap: int) -> Column:
    """The whole content, or null if there is more than cap."""
    return F.when(F.octet_length(content) <= cap, content)


def write_sanitized(results: DataFrame, path: str) -> None:
    """(safe_filename, sanitized) of the files that were put right, as Parquet."""
    results.where(F.col("sanitized").isNotNull()).select("payload_id", "safe_filename", "sanitized").write.mode("overwrite").parquet(path)


def write_sanitized_file(results: DataFrame, path: str) -> bool:
    """The bytes of the one file that was put right, at a path of the driver; False if there is none, ValueError if there are several."""
    found = results.where(F.col("sanitized").isNotNull()).select("sanitized").limit(2).collect()
    if len(found) > 1:
        raise ValueError("several files were put right: write_sanitized stores them as a table")
    for row in found:
        with open(path, "wb") as out:
            out.write(row["sanitized"])
    return bool(found)
