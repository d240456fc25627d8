"""Results as HTTP answers, exit codes, JSON and lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from assay.functions.values import SEVERITIES
from assay.plans.guard import errors
from assay.plans.policy import Policy


def status(found: Column, policy: Policy) -> Column:
    """413 for sizes, 415 for types, 422 for all else."""
    codes = F.transform(errors(found, policy), lambda f: f["code"])
    starts = lambda *s: F.exists(codes, lambda c: c.rlike(f"^({'|'.join(s)})[.]"))
    return F.when(starts("size"), 413).when(starts("type", "extension", "content_type"), 415).otherwise(422)


def severity_name(severity: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in SEVERITIES.items() for x in pair]), severity)


def _finding(f: Column) -> Column:
    return F.struct(f["code"].alias("code"), severity_name(f["severity"]).alias("severity"), f["message"].alias("message"), f["detail"].alias("detail"), f["remediated"].alias("remediated"))


def problem(results: DataFrame, policy: Policy) -> DataFrame:
    """(payload_id, status, body) of rejected payloads; body is JSON."""
    bad = errors(F.col("findings"), policy)
    message = F.array_join(F.transform(bad, lambda f: f["message"]), "; ")
    body = F.struct(F.lit("upload_rejected").alias("error"), F.when(message == "", "upload rejected").otherwise(message).alias("message"), F.col("detected.mime").alias("detected_type"), F.transform(bad, _finding).alias("findings"))
    return results.where(~F.col("ok")).select("payload_id", status(F.col("findings"), policy).alias("status"), F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))


def validation_code(code: Column) -> Column:
    """A finding's code as form validators write it."""
    return F.replace(code, F.lit("."), F.lit("_"))


def to_json(results: DataFrame) -> DataFrame:
    """(payload_id, json): each result as one JSON object; nulls are written."""
    ratio = F.when(F.col("archive.total_compressed") > 0, F.round(F.col("archive.total_uncompressed") / F.col("archive.total_compressed"), 2)).when(F.col("archive.total_uncompressed") == 0, 0.0)
    archive = F.when(F.col("archive").isNotNull(), F.struct("archive.*", ratio.alias("ratio")))
    whole = F.struct("ok", "filename", "safe_filename", "declared_extension", "declared_content_type", "detected", "size", F.transform("findings", _finding).alias("findings"), archive.alias("archive"), F.col("sanitized").isNotNull().alias("sanitized"))
    return results.select("payload_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("json"))


def to_text(results: DataFrame) -> DataFrame:
    """(payload_id, text): a line for the verdict and one for each finding."""
    line = F.concat_ws(" | ", F.when(F.col("ok"), "accepted").otherwise("rejected"), "payload_id", "detected.mime", "detected.description", F.concat(F.col("size").cast("string"), F.lit(" B")))
    each = F.transform("findings", lambda f: F.concat(F.lit("  - "), f["code"], F.lit(", "), F.when(f["remediated"], "put right").otherwise(severity_name(f["severity"])), F.lit(": "), f["message"]))
    return results.select("payload_id", F.array_join(F.concat(F.array(line), each), "\n").alias("text"))


def observed(results: DataFrame) -> tuple[DataFrame, Observation]:
    """results, and what will have been counted once they are written, in the pass that writes them.

    payloads, rejected, findings, exit_code (as exit_code() has it), and the codes of all
    findings, sorted; these are gathered as the sets of codes that payloads have.
    """
    seen = Observation()
    codes = F.transform("findings", lambda f: f["code"])
    counted = results.observe(
        seen,
        F.count(F.lit(1)).alias("payloads"),
        F.count_if(~F.col("ok")).alias("rejected"),
        F.coalesce(F.sum(F.size("findings")), F.lit(0)).alias("findings"),
        F.coalesce(F.max(F.when(~F.col("ok"), 1).otherwise(0)), F.lit(0)).alias("exit_code"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_sort(F.array_distinct(codes)))))).alias("codes"),
    )
    return counted, seen


def exit_code(results: DataFrame, failed: Column | None = None) -> DataFrame:
    """(exit_code): 0 if all is accepted, 1 if something is rejected, 2 if something could not be read."""
    code = F.when(F.lit(False) if failed is None else failed, 2).when(~F.col("ok"), 1).otherwise(0)
    return results.agg(F.coalesce(F.max(code), F.lit(0)).alias("exit_code"))
