"""Triage of payloads: what each one is, what is wrong with it, and whether it is accepted.

A payload is a row of payload_id, filename, content_type, size and content.  All checks
that need no unpacking are one projection.  SVG files and archives branch off to their
relations and come back by a row number of their own; policies that turn both off, or
`simple` scans, have no shuffle and no Python.  Files may be located (sources.ranged):
read by position, and again by their path where they are taken apart.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.detect import detect, is_unknown, preferred_extension
from assay.functions.durable import durable
from assay.functions.names import GENERIC_CONTENT_TYPES, canonical_extension, content_type_compatible, extension_matches, file_extension, filename_findings, normalize_content_type, sanitize_filename
from assay.functions.polyglot import embedded, trailing
from assay.functions.registry import known_extensions
from assay.functions.rules import MANY, holds, rules, with_rules
from assay.functions.ship import ship
from assay.functions.values import FINDING, HIGH, INFO, LOW, finding, findings, held, no_findings
from assay.operators.archive import Overflow, Unpacked, archive_kind
from assay.operators.archive import inspect as inspect_archives
from assay.operators.svg import sanitize_svg, scan_svg
from assay.plans.policy import Policy
from assay.sources.listing import list_files
from assay.sources.ranged import LOCATED, locate, with_content

#: Bytes of a file's beginning that its type may depend on.
BEGINNING = 1 << 16
PAYLOAD = ("payload_id", "filename", "content_type", "size", "oversized", "content")
#: Categories that are searched for other formats.
SEARCHED = ("image", "document", "font", "audio", "video", "data", "unknown")


class Rejected(ValueError):
    """Payloads were rejected; codes: of all errors."""

    def __init__(self, codes: list[str]):
        super().__init__(", ".join(codes))
        self.codes = codes


def normalized(payloads: DataFrame) -> DataFrame:
    """payloads with all columns of a payload: absent ones are null, size is that of the content."""
    if "payload_id" not in payloads.columns or "content" not in payloads.columns:
        raise TypeError("payloads need payload_id and content")
    has = set(payloads.columns)
    size = F.coalesce(F.col("size"), F.octet_length("content")) if "size" in has else F.octet_length("content")
    text = lambda c: F.col(c) if c in has else F.lit(None).cast("string")
    oversized = F.coalesce(F.col("oversized"), F.lit(False)) if "oversized" in has else F.lit(False)
    content = F.coalesce(F.col("content"), F.lit(b""))
    located = [c for c in LOCATED if set(LOCATED) <= has]
    return payloads.select(F.col("payload_id").cast("string").alias("payload_id"), text("filename").alias("filename"), text("content_type").alias("content_type"), size.cast("long").alias("size"), oversized.alias("oversized"), content.alias("content"), *located)


def size_findings(size: Column, oversized: Column, policy: Policy) -> Column:
    most = policy.max_size
    return findings(
        finding(oversized, "size.too_large", HIGH, f"over {most or 0} bytes", {"max_size": F.lit(most)}),
        finding(~oversized & (size < policy.min_size), F.when(size == 0, "size.empty").otherwise("size.too_small"), HIGH, F.when(size == 0, "empty").otherwise(f"under {policy.min_size} bytes"), {"size": size}),
        finding(~oversized & (size > F.lit(most).cast("long")), "size.too_large", HIGH, F.format_string(f"%d bytes, limit {most}", size), {"size": size, "max_size": F.lit(most)}),
    )


def name_findings(filename: Column, policy: Policy) -> Column:
    """Findings about the name, as the policy takes a missing extension or name."""
    found = filename_findings(filename, policy.dangerous_extensions, policy.filename_max_length, policy.flag_browser_active_extensions)
    missing = F.element_at(findings(finding(F.lit(True), "extension.missing", HIGH, "no extension")), 1)
    if policy.require_extension:
        return F.transform(found, lambda f: F.when(f["code"] == "filename.no_extension", missing).otherwise(f))
    empty = F.element_at(findings(finding(F.lit(True), "filename.empty", INFO, "no file name")), 1)
    return F.transform(found, lambda f: F.when(f["code"] == "filename.empty", empty).otherwise(f))


def ruled(rows: DataFrame, policy: Policy) -> tuple[DataFrame, Column, Column]:
    """rows, and whether a type that they have in `detected` is allowed and blocked; many rules are joined, few looked up."""
    out = []
    for name, asked in (("_allowed", rules(policy.allowed)), ("_blocked", rules(policy.blocked))):
        if len(asked) > MANY:
            rows = with_rules(rows, asked, name)
        out.append(F.col(name) if len(asked) > MANY else holds(asked, F.col("detected")))
    return rows, *out


def type_findings(detected: Column, extension: Column, declared: Column, head: Column, policy: Policy, allowed: Column, blocked: Column) -> Column:
    """Whether the name, the declared type and the rules agree with what the content is; allowed and blocked: what the rules say."""
    unknown, mime = is_unknown(detected), detected["mime"]
    wrong = ~unknown & (F.coalesce(extension, F.lit("")) != "") & F.lit(policy.strict_extension) & ~extension_matches(extension, detected["extensions"])
    odd_text = (mime == "text/plain") & ~canonical_extension(extension).isin(*known_extensions())
    checked = F.lit(policy.check_content_type) & (declared != "") & ~declared.isin(*GENERIC_CONTENT_TYPES) & ~unknown
    what = F.concat(detected["description"], F.lit(" ("), mime, F.lit(")"))
    return findings(
        finding(unknown & F.lit(not policy.allow_unknown), "type.unknown", HIGH, "the content is of no known type", {"head": F.lower(F.hex(F.substring(head, 1, 16)))}),
        finding(wrong & odd_text, "extension.unknown", LOW, F.concat(F.lit("plain text with the unknown extension ."), extension), {"declared": extension}),
        finding(wrong & ~odd_text, "extension.mismatch", HIGH, F.concat(F.lit("extension ."), extension, F.lit(" on "), mime), {"declared": extension, "detected_mime": mime, "expected": F.to_json(detected["extensions"])}),
        finding(checked & ~content_type_compatible(declared, detected), "content_type.mismatch", LOW, F.concat(declared, F.lit(" declared, "), mime, F.lit(" found")), {"declared": declared, "detected": mime}),
        finding(blocked, "type.blocked", HIGH, F.concat(what, F.lit(" is blocked")), {"mime": mime}),
        finding(F.lit(bool(rules(policy.allowed))) & ~allowed, "type.not_allowed", HIGH, F.concat(what, F.lit(" is not allowed")), {"mime": mime}),
    )


def safe_filename(filename: Column, detected: Column, policy: Policy, unicode_forms: bool = True) -> Column:
    safe = sanitize_filename(filename, policy.filename_replacement, policy.filename_max_length, ascii_only=policy.ascii_filenames, unicode_forms=unicode_forms)
    extension = preferred_extension(detected)
    return F.when(file_extension(safe).isNull() & extension.isNotNull(), F.concat(safe, F.lit("."), extension)).otherwise(safe)


def is_error(f: Column, policy: Policy) -> Column:
    return (f["severity"] >= policy.reject_threshold) & ~f["remediated"]


def errors(found: Column, policy: Policy) -> Column:
    return F.filter(found, lambda f: is_error(f, policy))


def warnings(found: Column, policy: Policy) -> Column:
    return F.filter(found, lambda f: ~is_error(f, policy))


def highest_severity(found: Column) -> Column:
    """Of findings that have not been put right; null if there is none."""
    return F.array_max(F.transform(F.filter(found, lambda f: ~f["remediated"]), lambda f: f["severity"]))


#: Unpacked bytes that are handed on together.
TOGETHER = 1 << 20


def unpacked_batches(batches: Iterator[pa.RecordBatch], cap: int) -> Iterator[pa.RecordBatch]:
    """(payload_id, content) of gzip files, unpacked, TOGETHER bytes at a time; null where that gives more than cap bytes, or nothing."""

    def whole(data: bytes | None) -> bytes | None:
        if data is None:
            return None
        try:
            return Unpacked(data, "gzip", cap).read(cap + 1)
        except (Overflow, zlib.error, OSError, EOFError):
            return None

    def batch_of(rows: list[tuple[str, bytes | None]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["payload_id", "content"])

    rows, held = [], 0
    for batch in batches:
        for payload, data in zip(*batch.columns, strict=True):
            rows.append((payload.as_py(), whole(data.as_py())))
            held += len(rows[-1][1] or b"")
            if held >= TOGETHER:
                yield batch_of(rows)
                rows, held = [], 0
    if rows:
        yield batch_of(rows)


def _gunzipped(packed: DataFrame, cap: int) -> DataFrame:
    """Rows and not a function of a column, which would hold what a whole batch of files unpacks to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return unpacked_batches(batches, cap)

    return packed.mapInArrow(run, "payload_id string, content binary")


def checked(payloads: DataFrame, policy: Policy, containers: bool = True) -> DataFrame:
    """payloads with detected, declared_extension, and the findings of every check that unpacks nothing: _first before, _last after those that do."""
    rows = detect(normalized(payloads), containers=containers)
    detected, content, size = F.col("detected"), F.col("content"), F.col("size")
    extension = file_extension(F.col("filename"))
    kind = archive_kind(detected["mime"], content)
    rows = rows.withColumn("declared_extension", extension).withColumn("archive_kind", kind)
    declared = normalize_content_type(F.col("content_type"))
    rows, allowed, blocked = ruled(rows, policy)
    first = F.concat(size_findings(size, F.col("oversized"), policy), name_findings(F.col("filename"), policy), type_findings(detected, F.col("declared_extension"), declared, content, policy, allowed, blocked))
    searched = (size > 0) & detected["category"].isin(*SEARCHED) & F.col("archive_kind").isNull()
    last = []
    if policy.polyglot_scan_limit:
        last.append(F.when(searched, embedded(content, detected, policy.polyglot_scan_limit)).otherwise(no_findings()))
    if policy.check_trailing_data:
        ends = {"size": size, "end": F.col("tail")} if "tail" in rows.columns else {"size": F.octet_length(content)}
        last.append(F.when(size > 0, trailing(content, detected, **ends)).otherwise(no_findings()))
    return rows.withColumn("_first", first).withColumn("_last", F.concat(*last) if last else no_findings())


def _result(rows: DataFrame, policy: Policy, unicode_forms: bool = True) -> DataFrame:
    safe = safe_filename(F.col("filename"), F.col("detected"), policy, unicode_forms)
    ok = ~F.exists("findings", lambda f: is_error(f, policy))
    return rows.select("payload_id", ok.alias("ok"), "filename", safe.alias("safe_filename"), "declared_extension", F.col("content_type").alias("declared_content_type"), "detected", "size", "findings", "archive", "sanitized")


def _reported(found: Column, due: Column) -> Column:
    """found; where a report is due and there is none, an error."""
    return F.when(due & found.isNull(), F.raise_error(F.lit("a payload was taken apart and has no report")).cast(f"array<{FINDING}>")).otherwise(found)


def scan(payloads: DataFrame, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """scan_results: payload_id, ok, filename, safe_filename, declared_extension, declared_content_type, detected, size, findings, archive, sanitized.

    Ids may be null or repeated: rows are told apart by a number of their own.  What the
    single pass over all payloads finds is written to the shared folder at once, with the
    content of SVG files and archives only, which are then taken apart.  A file that has
    to be taken apart and comes back without a report stops the job.
    """
    ship(payloads.sparkSession)
    rows = checked(payloads, policy)
    is_svg = F.col("detected.mime") == "image/svg+xml"
    apart = is_svg | (F.col("archive_kind").isNotNull() if policy.inspect_archives else F.lit(False))
    located = "path" in rows.columns
    if located:  # what is taken apart is read again by its path
        rows = rows.withColumn("path", F.when(apart & ~F.col("oversized"), F.col("path"))).drop("content", "tail", "listed", "streams")
    else:
        rows = rows.withColumn("content", F.when(apart, F.col("content")))
    rows = durable(rows.withColumn("_row", F.monotonically_increasing_id().cast("string")))
    gzipped = F.array_contains("detected.extensions", "svgz")
    cap = policy.svg_policy.max_bytes
    drawn = is_svg & (F.col("size") > 0)
    drawings = rows.where(drawn)
    if located:
        drawings = with_content(drawings.select("_row", "path", "detected"), cap)
    plain = drawings.where(~gzipped).select(F.col("_row").alias("payload_id"), F.when(F.octet_length("content") <= cap, F.col("content")).alias("content"))
    files = plain.unionByName(_gunzipped(drawings.where(gzipped).select(F.col("_row").alias("payload_id"), "content"), cap))
    look = sanitize_svg if policy.sanitize_svg else scan_svg
    svg = look(files.where(F.col("content").isNotNull()), policy.svg_policy)
    too_large = files.where(F.col("content").isNull()).select("payload_id", findings(finding(F.lit(True), "svg.too_large", HIGH, f"SVG of over {cap} bytes")).alias("svg_findings"), F.lit(None).cast("binary").alias("sanitized"))
    joined = rows.join(svg.unionByName(too_large).withColumnRenamed("payload_id", "_row"), "_row", "left").withColumn("svg_findings", _reported(F.col("svg_findings"), drawn))
    if policy.inspect_archives:
        packed_up = F.col("archive_kind").isNotNull() & (F.col("size") > 0)
        packed = rows.where(packed_up).select(F.col("_row").alias("payload_id"), "path" if located else "content", F.col("archive_kind").alias("archive"))
        joined = joined.join(inspect_archives(packed, policy.archive_limits, **({"path": "path"} if located else {})).withColumnRenamed("payload_id", "_row"), "_row", "left").withColumn("archive_findings", _reported(F.col("archive_findings"), packed_up))
    else:
        joined = joined.withColumn("archive", F.lit(None).cast("string")).withColumn("archive_findings", F.lit(None))
    parts = [F.col("_first"), *[F.coalesce(F.col(c).cast(f"array<{FINDING}>"), no_findings()) for c in ("svg_findings", "archive_findings")], F.col("_last")]
    return _result(joined.withColumn("findings", F.concat(*parts)), policy)


def scan_files(spark: SparkSession, paths: str | list[str], policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """scan() of all files below paths, empty ones too, which are read by position: files of any size, none of them held whole."""
    return scan(locate(list_files(spark, paths), max(policy.polyglot_scan_limit, BEGINNING), max_size=policy.max_size), policy)


def scan_simple(payloads: DataFrame, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """scan() without a look into containers and without Unicode forms: one projection over the source."""
    rows = checked(payloads, policy, containers=False)
    whole = rows.withColumn("findings", held(F.concat("_first", "_last"))).withColumn("archive", F.lit(None).cast("string")).withColumn("sanitized", F.lit(None).cast("binary"))
    return _result(whole, policy, unicode_forms=False)


def finding_rows(results: DataFrame) -> DataFrame:
    """findings: a row per finding, in order of appearance."""
    return results.select("payload_id", F.posexplode("findings").alias("position", "f")).select("payload_id", "position", "f.*")


def split(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected)."""
    return results.where("ok"), results.where(~F.col("ok"))


def check(payloads: DataFrame, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """scan(), but raises Rejected if any payload is rejected."""
    results = scan(payloads, policy)
    codes = results.where(~F.col("ok")).select(F.explode(errors(F.col("findings"), policy)).alias("f")).groupBy("f.code").count().orderBy("code")
    found = [r["code"] for r in codes.collect()]  # as many as there are codes
    if found:
        raise Rejected(found)
    return results


def roll_up(results: DataFrame) -> DataFrame:
    """Findings by type, code and severity."""
    return results.select("payload_id", F.col("detected.mime").alias("mime"), F.explode("findings").alias("f")).groupBy("mime", F.col("f.code").alias("code"), F.col("f.severity").alias("severity")).agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("payload_id").alias("payloads"))
