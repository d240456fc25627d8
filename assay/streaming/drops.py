"""Triage of a folder into which files are dropped."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assay.functions.durable import scope
from assay.functions.ship import ship
from assay.plans.guard import BEGINNING, scan, scan_simple
from assay.plans.policy import Policy
from assay.sources.listing import stream_files
from assay.sources.ranged import locate

FILE = "path string, modificationTime timestamp, length long, content binary"


def stream_payloads(spark: SparkSession, path: str) -> DataFrame:
    """A stream of whole files by Spark's own reader, from any store that it reaches; it leaves out files of no bytes."""
    files = spark.readStream.format("binaryFile").schema(FILE).load(path)
    return files.select(F.col("path").alias("payload_id"), F.substring_index("path", "/", -1).alias("filename"), F.lit(None).cast("string").alias("content_type"), F.col("length").alias("size"), F.lit(False).alias("oversized"), "content", "modificationTime")


def stream_located(spark: SparkSession, paths: str | list[str], policy: Policy = Policy(), late: datetime.timedelta = datetime.timedelta(hours=1)) -> DataFrame:  # noqa: B008
    """A stream of located payloads: files of any size, read by position, and those of no bytes too; late: as for stream_files()."""
    return locate(stream_files(spark, paths, late), max(policy.polyglot_scan_limit, BEGINNING), max_size=policy.max_size)


def scan_stream(payloads: DataFrame, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """Results as a stream: one projection, no state."""
    return scan_simple(payloads.drop("modificationTime"), policy)


def run(payloads: DataFrame, out: str, checkpoint: str, policy: Policy = Policy(), **trigger) -> StreamingQuery:  # noqa: B008
    """Full results of each batch, appended to Parquet in a folder for the batch; a batch that is run again replaces its own.

    What a batch writes on the way is deleted once its results are stored.
    """

    ship(payloads.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        with scope(batch.sparkSession):
            scan(batch.drop("modificationTime"), policy).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return payloads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def rejection_rates(results: DataFrame, at: str = "modificationTime", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rejected and all payloads by window, from results with the time of arrival in `at`; late ones are let in for so long."""
    return results.withWatermark(at, late).groupBy(F.window(at, width)).agg(F.count_if(~F.col("ok")).alias("rejected"), F.count(F.lit(1)).alias("payloads"))
