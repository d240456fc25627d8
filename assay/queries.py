"""The registered queries of the triage operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay import derived, wrapped
from assay.functions import names, paths, polyglot, registry, rules, signatures, text, urls
from assay.functions.binary import binary_kind
from assay.functions.detect import kind_struct, with_kind
from assay.functions.durable import durable, folder
from assay.functions.values import latin, part
from assay.operators import archive, svg
from assay.plans import guard, http, sql
from assay.plans.policy import Policy
from assay.sources.folder_sink import write_files
from assay.sources.listing import list_files
from assay.sources.payloads import from_table
from assay.sources.ranged import locate
from assay.streaming import drops

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
POLICY = Policy()


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def coded(found: Column) -> Column:
    """code:severity of findings, joined in their order."""
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["code"], f["severity"].cast("string"))), ",")


# ---------------------------------------------------------------- names


@query
def filename_findings(spark, sf_dir):
    return derived.uploads(spark, sf_dir).select("k", coded(names.filename_findings(F.col("filename"), flag_browser_active=True)).alias("codes"))


@query
def filename_rollup(spark, sf_dir):
    rows = derived.uploads(spark, sf_dir).select(F.explode(names.filename_findings(F.col("filename"), flag_browser_active=True)).alias("f"))
    return rows.groupBy(F.col("f.code").alias("code"), F.col("f.severity").alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query
def split_extension(spark, sf_dir):
    f = F.col("filename")
    return derived.uploads(spark, sf_dir).select("k", names.file_stem(f).alias("stem"), names.file_extension(f).alias("extension"))


@query
def all_suffixes(spark, sf_dir):
    return derived.uploads(spark, sf_dir).select("k", F.array_join(names.all_extensions(F.col("filename")), "|").alias("suffixes"))


@query
def filename_safe_ascii(spark, sf_dir):
    return derived.uploads(spark, sf_dir).select("k", names.sanitize_filename(F.col("filename"), ascii_only=True, unicode_forms=False).alias("safe"))


@query
def extension_lookup(spark, sf_dir):
    e = names.file_extension(F.col("filename"))
    return derived.uploads(spark, sf_dir).select("k", names.canonical_extension(e).alias("usual"), names.mime_for_extension(e).alias("mime"))


@query
def extension_join(spark, sf_dir):
    """The same look-up as a join: uploads with each type that has their extension."""
    rows = derived.uploads(spark, sf_dir).select("k", names.canonical_extension(names.file_extension(F.col("filename"))).alias("canonical"))
    kinds = registry.kinds_frame(spark).groupBy("canonical").agg(F.count_distinct("position").alias("types"))
    return rows.join(F.broadcast(kinds), "canonical").select("k", "canonical", "types")  # the registry, a few hundred rows


@query
def extension_match(spark, sf_dir):
    detected = kind_struct(F.col("kind"))
    return derived.uploads(spark, sf_dir).select("k", names.extension_matches(names.file_extension(F.col("filename")), detected["extensions"]).alias("matches"))


@query
def content_type_compat(spark, sf_dir):
    declared = names.normalize_content_type(F.col("content_type"))
    return derived.uploads(spark, sf_dir).select("k", declared.alias("declared"), F.coalesce(names.content_type_compatible(declared, kind_struct(F.col("kind"))), F.lit(False)).alias("compatible"))


RULES = ("image/*", "application/pdf", ".docx", "category:archive")


@query
def type_rules(spark, sf_dir):
    detected = kind_struct(F.col("kind"))
    asked = rules.rules(RULES)
    return derived.uploads(spark, sf_dir).select("k", *[rules.holds([r], detected).alias(f"rule_{i}") for i, r in enumerate(asked)], rules.holds(asked, detected).alias("any_rule"))


@query
def type_rules_join(spark, sf_dir):
    """The same by joins: any number of rules against the words of the registry, the outcome against the rows."""
    rows = derived.uploads(spark, sf_dir).select("k", kind_struct(F.col("kind")).alias("detected"))
    for i, r in enumerate(RULES):
        rows = rules.with_rules(rows, rules.rules(r), f"rule_{i}")
    return rules.with_rules(rows, rules.rules(RULES), "any_rule").drop("detected")


@query
def size_findings(spark, sf_dir):
    policy = Policy(min_size=5, max_size=5000)
    return derived.uploads(spark, sf_dir).select("k", coded(guard.size_findings(F.col("size"), F.col("k") % 7 == 0, policy)).alias("codes"))


# ---------------------------------------------------------------- types


@query
def signature_first(spark, sf_dir):
    """The first signature that matches, as a CASE."""
    head = F.substring("content", 1, registry.HEAD)
    out = None
    for i, s in enumerate(registry.ORDERED):
        hit = part(head, s.offset, len(s.magic)) == F.lit(s.magic)
        out = F.when(hit, i) if out is None else out.when(hit, i)
    return derived.blobs(spark, sf_dir).select("k", out.alias("rank"))


@query
def signature_join(spark, sf_dir):
    """The same by hash joins with the signature table, the lowest rank kept."""
    rows = derived.blobs(spark, sf_dir).select("k", F.substring("content", 1, registry.HEAD).alias("content"))
    return signatures.ranked(rows, registry.signatures_frame(spark)).where("rank IS NOT NULL").select("k", "rank")


@query
def binary_kinds(spark, sf_dir):
    return derived.blobs(spark, sf_dir).select("k", binary_kind(F.col("content")).alias("kind"))


@query
def control_ratio(spark, sf_dir):
    sample = latin(F.substring("content", 1, 1024))
    return derived.blobs(spark, sf_dir).select("k", F.length(F.regexp_replace(sample, r"(?s)[^\x00-\x08\x0b\x0c\x0e-\x1a\x1c-\x1f\x7f]", "")).alias("controls"), text.head_text(F.col("content")).isNull().alias("binary"))


@query
def text_kinds(spark, sf_dir):
    return with_kind(derived.texts(spark, sf_dir), to="kind", containers=False).select("k", "kind")


@query
def page_kinds(spark, sf_dir):
    rows = derived.table(spark, sf_dir, "pages").select(F.col("page_id").alias("k"), F.col("html").cast("binary").alias("content"))
    return with_kind(rows, to="kind", containers=False).select("k", "kind")


@query
def json_kinds(spark, sf_dir):
    rows = derived.table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), F.col("props").cast("binary").alias("content"))
    return with_kind(rows, to="kind", containers=False).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query
def markup_prologs(spark, sf_dir):
    rows = derived.texts(spark, sf_dir).select("k", text.markup_prolog(text.head_text(F.col("content"))).alias("p"))
    return rows.select("k", F.col("p.doctype").alias("doctype"), F.col("p.declared").alias("declared"))


# ---------------------------------------------------------------- other formats inside and after


@query
def polyglot_markers(spark, sf_dir):
    rows = derived.bodies(spark, sf_dir)
    found = polyglot.embedded(F.col("content"), kind_struct(F.col("kind")))
    return rows.select("k", F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["code"], f["severity"].cast("string"), f["detail"]["offset"])), ",").alias("codes"))


#: Bytes to look for, and the first offset that counts.
OWN_MARKERS = {"token": (b"token", 0), "stop": (b".\n", 0), "letter": (b"E", 1)}


@query
def own_markers(spark, sf_dir):
    """Where the first of some byte strings stand in every document, all of them found in one pass."""
    rows = derived.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    sought = [polyglot.byte_marker(name, content, 0, first) for name, (content, first) in OWN_MARKERS.items()]
    found = rows.select("k", polyglot.offsets(latin(F.col("content")), sought).alias("at"))
    return found.select("k", *[F.col("at")[i].cast("long").alias(f"at_{name}") for i, name in enumerate(OWN_MARKERS)])


@query
def trailing_data(spark, sf_dir):
    rows = derived.bodies(spark, sf_dir)
    found = polyglot.trailing(F.col("content"), kind_struct(F.col("kind")))
    return rows.select("k", F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["code"], f["severity"].cast("string"), F.coalesce(f["detail"]["trailing_bytes"], F.lit("")))), ",").alias("codes"))


# ---------------------------------------------------------------- URLs and styles


@query
def url_classes(spark, sf_dir):
    return derived.urls(spark, sf_dir).select("k", urls.classify_url(F.col("url")).alias("class"))


@query
def page_link_classes(spark, sf_dir):
    links = derived.table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('(?:href|src)="([^"]*)"'), 1)).alias("url"))
    return links.groupBy(urls.classify_url(F.col("url")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query
def css_verdicts(spark, sf_dir):
    css = F.col("css")
    return derived.styles(spark, sf_dir).select("k", urls.css_scripts(css).alias("scripts"), urls.css_reaches_out(css).alias("reaches_out"), urls.css_cleaned(css).alias("cleaned"))


@query
def svg_attribute_rules(spark, sf_dir):
    rows = derived.urls(spark, sf_dir)
    element = derived.by_case(F.col("k"), [F.lit(e) for e in ("a", "use", "image", "rect")])
    found, _ = svg.attribute_verdict(element, F.lit("href"), F.col("url"), svg.SvgPolicy())
    return rows.select("k", F.coalesce(F.concat_ws(":", found["code"], found["severity"].cast("string")), F.lit("")).alias("verdict"))


# ---------------------------------------------------------------- archives as relations


@query
def unsafe_member_paths(spark, sf_dir):
    return derived.members(spark, sf_dir).select("k", paths.unsafe_member(F.col("name")).alias("unsafe"))


@query
def unsafe_link_targets(spark, sf_dir):
    return derived.members(spark, sf_dir).select("k", paths.unsafe_link(F.col("name"), F.col("target")).alias("unsafe"))


@query
def nested_names(spark, sf_dir):
    return derived.members(spark, sf_dir).select("k", paths.nested_archive(F.col("name")).alias("nested"))


@query
def zip_overlaps(spark, sf_dir):
    return archive.overlapping(derived.listing(spark, sf_dir), ["archive"])


@query
def archive_running_budget(spark, sf_dir):
    kept = archive.within_budget(derived.listing(spark, sf_dir), ["archive"], 100_000)
    return kept.groupBy("archive").agg(F.count(F.lit(1)).alias("entries"), F.max("_total").alias("total"), F.max(F.col("_total") > 100_000).alias("truncated"))


@query
def archive_first_entries(spark, sf_dir):
    return derived.listing(spark, sf_dir).where("idx < 3").groupBy("archive").agg(F.sum("size").alias("size"))


@query
def archive_ratios(spark, sf_dir):
    sums = derived.listing(spark, sf_dir).groupBy("archive").agg(F.sum("size").alias("size"), F.sum("packed").alias("packed"))
    r = archive.ratio(F.col("size"), F.col("packed"))
    return sums.select("archive", r.alias("ratio"), (r > 15).alias("bomb"))


@query
def archive_rollup(spark, sf_dir):
    rows = derived.listing(spark, sf_dir)
    return rows.groupBy("archive").agg(F.count(F.lit(1)).alias("entry_count"), F.sum("size").alias("total_uncompressed"), F.sum("packed").alias("total_compressed"), F.count_if(F.col("packed") % 2 == 1).alias("encrypted"))


# ---------------------------------------------------------------- verdicts


def _page_payloads(pages: DataFrame) -> DataFrame:
    name = F.concat(F.regexp_extract("url", "([^/?]*)(?:\\?.*)?$", 1), derived.by_case(F.col("page_id"), [F.lit(e) for e in (".html", ".htm", ".png", "", ".php.html", ".txt")]))
    declared = derived.by_case(F.col("page_id"), [F.lit(c) for c in ("text/html", "text/plain", "image/png", "")])
    return from_table(pages, "html", "page_id", name, declared)


def _simple(spark, sf_dir) -> DataFrame:
    return guard.scan_simple(_page_payloads(derived.table(spark, sf_dir, "pages")), POLICY)


@query
def stream_scan(spark, sf_dir):
    """The pages as a stream of files, triaged batch by batch into a folder of the shared one; then what the folder holds."""
    at = f"{sf_dir}/pages[.]parquet"  # a pattern, as the table may be one file
    pages = spark.readStream.schema(derived.table(spark, sf_dir, "pages").schema).parquet(at)
    run = folder(spark, "stream")
    drops.run(_page_payloads(pages), f"{run}/out", f"{run}/checkpoint", POLICY).awaitTermination()
    found = spark.read.schema(guard.scan(_page_payloads(derived.table(spark, sf_dir, "pages")).limit(0), POLICY).schema).option("recursiveFileLookup", "true").parquet(f"{run}/out")
    return found.select(F.col("payload_id").cast("long").alias("k"), "ok", coded(F.col("findings")).alias("codes"))


@query
def page_verdicts(spark, sf_dir):
    rows = _simple(spark, sf_dir)
    return rows.select(F.col("payload_id").cast("long").alias("k"), "ok", coded(F.col("findings")).alias("codes"), guard.highest_severity(F.col("findings")).alias("highest"), coded(guard.errors(F.col("findings"), POLICY)).alias("errors"), F.size(guard.warnings(F.col("findings"), POLICY)).alias("warnings"))


@query
def http_statuses(spark, sf_dir):
    return http.problem(_simple(spark, sf_dir), POLICY).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query
def findings_rollup(spark, sf_dir):
    return guard.roll_up(_simple(spark, sf_dir))


@query
def accepted_split(spark, sf_dir):
    accepted, rejected = guard.split(_simple(spark, sf_dir))
    count = lambda rows, name: rows.agg(F.lit(name).alias("side"), F.count(F.lit(1)).alias("n"))
    return count(accepted, "accepted").unionByName(count(rejected, "rejected"))


@query
def exit_codes(spark, sf_dir):
    return http.exit_code(_simple(spark, sf_dir))


# ---------------------------------------------------------------- what has no SQL form


@query
def container_kinds(spark, sf_dir):
    return with_kind(wrapped.wrapped(spark, sf_dir)).select("payload_id", "kind")


@query
def archive_reports(spark, sf_dir):
    """What each archive holds, as it is reported, and what is wrong with it."""
    rows = with_kind(wrapped.wrapped(spark, sf_dir), to="_kind")
    rows = rows.withColumn("archive", archive.archive_kind(kind_struct(F.col("_kind"))["mime"], F.col("content")))
    found = archive.inspect(durable(rows))  # looked into once; the report reads it several times
    report = ["archive.format", F.col("archive.entry_count").cast("long").alias("entry_count"), "archive.total_uncompressed", F.col("archive.max_depth").cast("int").alias("max_depth")]
    return found.select("payload_id", *report, F.array_join("archive.nested_archives", ",").alias("nested"), F.array_join("archive.unsafe_paths", ",").alias("unsafe"), coded(F.col("archive_findings")).alias("codes"))


def _limited(found: DataFrame) -> DataFrame:
    each = F.transform("archive_findings", lambda f: F.concat_ws(":", f["code"], f["severity"].cast("string")))
    return found.select("payload_id", F.col("archive.entry_count").cast("long").alias("entry_count"), "archive.truncated", F.array_join(F.array_sort(F.array_distinct(each)), ",").alias("codes"))


@query
def archive_limits(spark, sf_dir):
    """Archives on both sides of every limit, each of them set by the size of a text; codes sorted, each once."""
    rows = with_kind(wrapped.limited(spark, sf_dir), to="_kind")
    rows = rows.withColumn("archive", archive.archive_kind(kind_struct(F.col("_kind"))["mime"], F.col("content")))
    return _limited(archive.inspect(durable(rows), wrapped.LIMITS))


@query
def located_archives(spark, sf_dir):
    """The same archives as files that tasks have written, listed and read by position; their sizes are verified in many tasks."""
    at = folder(spark, "files")
    write_files(wrapped.limited(spark, sf_dir).withColumn("name", F.concat_ws("-", "payload_id", "filename")), at, "name")
    files = with_kind(locate(list_files(spark, at)), to="_kind")
    kind = archive.archive_kind(kind_struct(F.col("_kind"))["mime"], F.col("content"))
    rows = durable(files.select(F.split_part("filename", F.lit("-"), F.lit(2)).alias("payload_id"), "path", kind.alias("archive")))
    return _limited(archive.inspect(rows, wrapped.LIMITS, path="path"))


@query
def located_kinds(spark, sf_dir):
    """container_kinds of files that are read by their beginning, end and directory."""
    at = folder(spark, "files")
    write_files(wrapped.wrapped(spark, sf_dir).withColumn("name", F.concat_ws("-", "payload_id", "filename")), at, "name")
    files = locate(list_files(spark, at), head=1 << 16)
    return with_kind(files).select(F.split_part("filename", F.lit("-"), F.lit(2)).alias("payload_id"), "kind")


@query
def file_stream(spark, sf_dir):
    """Documents as files, every seventh of no bytes, in a stream of listings: each once, with its size and whether it is found empty."""
    at, run = folder(spark, "files"), folder(spark, "stream")
    rows = derived.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("payload_id"), F.when(F.col("doc_id") % 7 != 0, F.col("text")).cast("binary").alias("content"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"))
    write_files(rows, at)
    found = drops.stream_located(spark, at, POLICY).select(F.regexp_extract("filename", "-(-?\\d+)\\.", 1).cast("long").alias("k"), "size", coded(guard.size_findings(F.col("size"), F.col("oversized"), POLICY)).alias("codes"))
    found.writeStream.format("parquet").option("path", f"{run}/out").option("checkpointLocation", f"{run}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{run}/out")


@query
def sql_types(spark, sf_dir):
    """container_kinds in SQL: the MIME type by a function of Spark SQL."""
    sql.register(spark)
    wrapped.wrapped(spark, sf_dir).createOrReplaceTempView("assay_wrapped")
    return spark.sql("SELECT payload_id, detect_type(content).mime AS mime FROM assay_wrapped")


@query
def observed_counts(spark, sf_dir):
    """What was counted while results were written, in the one pass that wrote them."""
    results, seen = http.observed(_simple(spark, sf_dir))
    durable(results)
    told = seen.get
    return spark.createDataFrame([(told["payloads"], told["rejected"], told["exit_code"], ",".join(told["codes"]))], "payloads long, rejected long, exit_code int, codes string")


@query
def svg_scan(spark, sf_dir):
    """Codes of every document inside an SVG file, sorted."""
    each = F.transform("svg_findings", lambda f: F.concat_ws(":", f["code"], f["severity"].cast("string")))
    return svg.scan_svg(wrapped.drawings(spark, sf_dir)).select("payload_id", F.array_join(F.array_sort(each), ",").alias("codes"))


@query
def svg_sanitize(spark, sf_dir):
    return svg.sanitize_svg(wrapped.drawings(spark, sf_dir)).select("payload_id", coded(F.col("svg_findings")).alias("codes"), F.sha2("sanitized", 256).alias("sanitized_sha256"))


@query
def safe_filename_nfkc(spark, sf_dir):
    return derived.uploads(spark, sf_dir).select("k", names.sanitize_filename(F.col("filename")).alias("safe"))


@query
def triage(spark, sf_dir):
    """The whole policy over wrapped documents."""
    rows = guard.scan(wrapped.wrapped(spark, sf_dir), POLICY)
    return rows.select("payload_id", "ok", "safe_filename", F.col("detected.mime").alias("mime"), coded(F.col("findings")).alias("codes"))
