"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every version of a file is addressed by the SHA-256 of its content.  The ledger, a table
in a folder that all machines share, says which (blob, rule version) pairs have been
scanned and what they hold; a run scans the pairs that it lacks, once for all paths that
share a blob, appends them, and findings are joined back to every path.  A rule version
is a digest of the rules, so other rules are never taken for scanned.

Matches are fenced by marks and the text is split at the marks; offsets are running
sums over the pieces, and stretches to redact running maxima, so that the time of a text
follows its length, however many secrets it has.

Offsets count code points, ends are exclusive.  A null content is an empty one.
Defined cases: repeated rows give repeated rows; empty content has no finding; ties of
start are ordered by the rules' order; other columns of the versions do not matter; a
path whose blob has not been scanned under the rules has null spans.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assay.llm.common import has_columns, materialize, schema_of, text_or_empty

_MARK, _VALUE, _OTHER = "\x01", "\x02", "\x03"
LEDGER = "blob string, rules string, spans array<struct<start:int,rule:int,kind:string,end:int>>"


@dataclass(frozen=True)
class Rule:
    """kind: the name; head, value: a match is head then value; shortest: characters that the value has at least."""

    kind: str
    head: str
    value: str
    shortest: int


def either_case(word: str) -> str:
    """A pattern of word's letters in either case, alike in every dialect."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


RULES = (
    Rule("assign", f"(?:{either_case('password|passwd|secret|token|api_?key')})[\"']?\\x20*[:=]\\x20*[\"']?", "[A-Za-z0-9+/_.=-]+", 6),
    Rule("access", "", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "", "[0-9a-f]{24,}", 24),  # a run of 24 or more is a whole run of one or more
)
#: Code points of a text that are cut off together when it is redacted.
_CHUNK = 1_024


def rules_version(rules: tuple[Rule, ...] = RULES) -> str:
    """A name of exactly these rules in this order."""
    return hashlib.sha256(repr([(r.kind, r.head, r.value, r.shortest) for r in rules]).encode()).hexdigest()[:16]


def _pieces(text: Column, number: int, rule: Rule) -> Column:
    """array<struct<rule,piece,size,hit>>: text cut before and after each match of the rule; hit: a match that is long enough."""
    plain = F.translate(text, _MARK + _VALUE, _OTHER + _OTHER)
    fenced = F.regexp_replace(plain, f"({rule.head})({rule.value})", f"{_MARK}$1{_VALUE}$2{_MARK}")

    def describe(piece: Column, i: Column) -> Column:
        is_match = i % 2 == 1
        size = F.length(piece) - is_match.cast("int")  # without the mark before the value
        return F.struct(F.lit(number).alias("rule"), i.alias("piece"), size.alias("size"), (is_match & (F.length(F.substring_index(piece, _VALUE, -1)) >= rule.shortest)).alias("hit"))

    return F.transform(F.split(fenced, _MARK), describe)


def find_spans(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans) of blobs(blob, body), one row each: all rules' leftmost non-overlapping matches, by start, then rule."""
    cut = blobs.select("blob", F.explode(F.concat(*[_pieces(F.col("body"), i, r) for i, r in enumerate(rules)])).alias("p")).select("blob", "p.*")
    end = F.sum("size").over(Window.partitionBy("blob", "rule").orderBy("piece")).cast("int")
    placed = cut.withColumn("end", end)
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("rule") + 1)
    span = F.struct((F.col("end") - F.col("size")).alias("start"), "rule", kind.alias("kind"), "end")
    return placed.groupBy("blob").agg(F.sort_array(F.collect_list(F.when(F.col("hit"), span))).cast(schema_of(LEDGER)["spans"].dataType).alias("spans"))


def address(content: str = "content") -> Column:
    return F.sha2(text_or_empty(content).cast("binary"), 256)


def scan_new(versions: DataFrame, ledger: DataFrame | None = None, content: str = "content", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger's new rows: (blob, rules, spans) of blobs in versions that the ledger lacks under these rules.

    Copies of a blob collapse within each task before they are shuffled, and only then is
    the ledger asked, which is dealt out by blob as they are.
    """
    has_columns(versions, content)
    unseen = versions.select(address(content).alias("blob"), text_or_empty(content).alias("body")).groupBy("blob").agg(F.first("body").alias("body"))
    if ledger is not None:
        unseen = unseen.join(ledger.where(F.col("rules") == rules_version(rules)).select("blob"), "blob", "left_anti")
    return find_spans(unseen, rules).select("blob", F.lit(rules_version(rules)).alias("rules"), "spans")


def join_paths(versions: DataFrame, ledger: DataFrame, path: str = "path", content: str = "content", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, blob, spans): the ledger's findings for every row of versions.

    A blob with very many paths is split by rows if the ledger is a written table.
    """
    has_columns(versions, path, content)
    known = ledger.where(F.col("rules") == rules_version(rules)).select("blob", "spans")
    return versions.select(F.col(path).alias("path"), address(content).alias("blob")).join(known, "blob", "left").select("path", "blob", "spans")


class Ledger:
    """A stored ledger: Parquet at `path`, a folder for each rule version; created where there is none."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.createDataFrame([], LEDGER).write.mode("ignore").partitionBy("rules").parquet(path)

    def rows(self) -> DataFrame:
        """All that has been scanned."""
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def scan(self, versions: DataFrame, content: str = "content", rules: tuple[Rule, ...] = RULES) -> None:
        """Scan the blobs of versions that the ledger lacks under these rules, and append them."""
        scan_new(versions, self.rows(), content, rules).write.mode("append").partitionBy("rules").parquet(self.path)

    def findings(self, versions: DataFrame, path: str = "path", content: str = "content", rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(path, blob, spans) for every row of versions, scanned by whatever run.

        Runs at the same time may have scanned the same blob: it counts once.  What is
        joined is written, so that a blob with very many paths is split by rows.
        """
        once = materialize(self.rows().where(F.col("rules") == rules_version(rules)).dropDuplicates(["blob"]))
        return join_paths(versions, once, path, content, rules)


def findings(paths: DataFrame) -> DataFrame:
    """One row (path, blob, kind, start, end) per span."""
    return paths.select("path", "blob", F.explode("spans").alias("s")).select("path", "blob", "s.kind", "s.start", "s.end")


def digest(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def clean_stretches(spans: DataFrame) -> DataFrame:
    """(blob, gaps array<struct<from,to>>, last) of spans(blob, spans): what lies before each stretch of overlapping spans, and where the last ends."""
    each = spans.select("blob", F.explode("spans").alias("s")).select("blob", "s.start", "s.end", "s.rule")
    before = F.max("end").over(Window.partitionBy("blob").orderBy("start", "rule").rowsBetween(Window.unboundedPreceding, -1))
    placed = each.withColumn("before", F.coalesce(before, F.lit(0)))
    gap = F.when((F.col("start") >= F.col("before")) & (F.col("end") > F.col("start")), F.struct(F.col("before").alias("from"), F.col("start").alias("to")))
    return placed.groupBy("blob").agg(F.sort_array(F.collect_list(gap)).alias("gaps"), F.max("end").alias("last"))


def redact(text: Column, gaps: Column, last: Column, by: str = "[SECRET]") -> Column:
    """text with `by` between the gaps and what follows `last`; cut by way of chunks, as a place in a text is found from its start."""

    def cut(chunks: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            first, final = F.floor(a / _CHUNK).cast("int"), F.floor(b / _CHUNK).cast("int")
            chunk = lambda i: F.coalesce(F.get(chunks, i), F.lit(""))
            whole = F.array_join(F.slice(chunks, first + 2, final - first - 1), "")
            apart = F.concat(F.substring(chunk(first), a % _CHUNK + 1, F.lit(_CHUNK)), whole, F.substring(chunk(final), F.lit(1), b % _CHUNK))
            return F.when(first == final, F.substring(chunk(first), a % _CHUNK + 1, b - a)).otherwise(apart)

        return F.array_join(F.concat(F.transform(gaps, lambda g: between(g["from"], g["to"])), F.array(between(last, F.length(text)))), by)

    bound = F.transform(F.array(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))), cut)  # chunks are made once
    return F.get(bound, F.lit(0))


def redacted(docs: DataFrame, text: str = "text", ledger: Ledger | None = None) -> DataFrame:
    """docs with every secret in text replaced; texts without any stay as they are, null too.  Scans what the ledger lacks."""
    columns = docs.columns
    if ledger is not None:
        ledger.scan(docs, text)
    known = materialize(scan_new(docs, None, text)) if ledger is None else ledger.rows().where(F.col("rules") == rules_version())
    dirty = materialize(clean_stretches(known.where(F.size("spans") > 0).select("blob", "spans"))).select(F.col("blob").alias("_blob"), F.col("gaps").alias("_gaps"), F.col("last").alias("_last"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), address(text).alias("_at"))
    joined = rows.join(dirty.hint("shuffle_hash"), F.col("_at") == F.col("_blob"), "left")
    whole = F.col("_row").getField(text)
    clean = F.when(F.col("_gaps").isNotNull(), redact(whole, F.col("_gaps"), F.col("_last"))).otherwise(whole)
    return joined.select(*[(clean if c == text else F.col("_row").getField(c)).alias(c) for c in columns])
