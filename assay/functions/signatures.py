"""Signatures as hash tables: one for each place and length, looked up with the few bytes that stand there.

A row is never compared with signature after signature.  The signatures of one offset and
length are a table from bytes to the least rank; a row takes its own bytes there to it in a
broadcast hash join, once for each place and length that the signatures have, and the least
of the ranks that come back is its.  No row is repeated and none is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions.values import part


def ranked(rows: DataFrame, signatures: DataFrame, content: str = "content", to: str = "rank") -> DataFrame:
    """rows with the least rank of the signatures (rank, magic, offset) that content has; null if it has none.

    The signatures are a table of fixed values: it goes to every task, and what places and
    lengths it has is asked first.
    """
    shapes = signatures.select("offset", F.octet_length("magic").alias("size")).distinct().orderBy("offset", "size").collect()
    found = []
    for i, shape in enumerate(shapes):
        same = signatures.where((F.col("offset") == shape["offset"]) & (F.octet_length("magic") == shape["size"]))
        table = same.groupBy(F.col("magic").alias(f"_magic{i}")).agg(F.min("rank").alias(f"_rank{i}"))
        rows = rows.join(F.broadcast(table), part(F.col(content), shape["offset"], shape["size"]) == F.col(f"_magic{i}"), "left").drop(f"_magic{i}")
        found.append(f"_rank{i}")
    least = F.array_min(F.array(*found)) if found else F.lit(None).cast("int")
    return rows.withColumn(to, least).drop(*found)
