"""Shared steps of the corpus operators: durable intermediate tables, ranks over hot groups, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from assay.functions.durable import durable as materialize
from assay.functions.durable import forget, shared_dir, written
from assay.functions.ship import ship

__all__ = ["CELL_ROWS", "components", "group_rank", "has_columns", "materialize", "schema_of", "shared_dir", "spread", "text_or_empty"]

#: Rows that one cell of a salted rank holds on average; cells grow in number, not in size.
CELL_ROWS = 50_000


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def has_columns(df: DataFrame, *names: str) -> None:
    """Every operator begins here: df has the columns, and executors have the package."""
    ship(df.sparkSession)
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def spread(rows: int, per_cell: int = CELL_ROWS) -> int:
    """How many hash cells keep a group of all rows at per_cell rows a cell."""
    return max(1, -(-rows // per_cell))


def group_rank(df: DataFrame, group: str, order: list[str], cells: int, to: str = "rank", cell_of: Column | None = None) -> DataFrame:
    """Add the 0-based rank of each row within its group, and the group's size as `<to>_of`.

    The order is: cell, then `order`.  `cell_of` gives a row's cell, from 0 to cells - 1
    (default: a hash of all order columns).
    No window spans a whole group: rows are ranked within (group, cell), and the
    cells' offsets come from their counts, so a group with a third of all rows is
    spread over `cells` tasks.  Null groups are a group of their own.
    """
    cell = (F.pmod(F.xxhash64(*order), F.lit(cells)) if cell_of is None else cell_of).cast("int")
    salted = df.withColumn("_cell", cell)
    counts = salted.groupBy(group, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    by_group = Window.partitionBy(group).orderBy("_cell")
    offsets = counts.select(
        F.col(group).alias("_g"),
        F.col("_cell").alias("_c"),
        (F.sum("_n").over(by_group) - F.col("_n")).alias("_before"),
        F.sum("_n").over(Window.partitionBy(group)).alias("_of"),
    )
    ranked = salted.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_cell").orderBy(*order)) - 1)
    joined = ranked.join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_cell") == F.col("_c")))
    return joined.withColumn(to, (F.col("_before") + F.col("_r")).cast("long")).withColumn(f"{to}_of", F.col("_of").cast("long")).drop("_cell", "_r", "_g", "_c", "_before", "_of")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges(a long, b long): one row (node, root) per node that has an edge; root is the smallest node reachable.

    Alternating large-star and small-star steps.  Each step is a partially
    aggregated minimum per node, written and joined back to the edges from two plain
    shuffles, so that Spark splits a hub with very many edges by rows.  Every round is
    written to the shared folder and the one before deleted; only a count and a checksum
    reach the driver.
    """
    spark = edges.sparkSession
    now, at = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _checksum(now)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        large, *used = _large_star(now)
        small, *more = _small_star(*written(large))
        now, new = written(small)
        forget(spark, at, *used, *more)
        at, after = new, _checksum(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    children = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return children.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return int(row["n"]), row["s"]


def _large_star(edges: DataFrame) -> tuple[DataFrame, str]:
    """The next edges, and the path of the table that they still read besides edges."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least, at = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct(), at


def _small_star(edges: DataFrame, at: str) -> tuple[DataFrame, str, str]:
    """The next edges of edges, written at `at`, and the paths of the tables that they still read."""
    least, more = written(edges.groupBy("a").agg(F.min("b").alias("m")))
    linked = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), at, more


def schema_of(text: str) -> T.StructType:
    return T._parse_datatype_string(text)
