"""Operators as functions of Spark SQL.

Spark writes an expression as SQL text but for its lambda functions, which come out as
calls; lambdas_as_sql() puts these right, so that any expression of this library can be the
body of an SQL function.  What such a function does is then planned like everything else.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from assay.functions import names, paths, polyglot, urls
from assay.functions.binary import binary_kind
from assay.functions.detect import DETECTED, kind_struct
from assay.functions.registry import HEAD
from assay.functions.ship import ship, small_batches
from assay.functions.text import head_text, left_trimmed, markup_prolog, text_kind
from assay.functions.values import let
from assay.operators import archive, containers, svg


def _named(name: str) -> Callable[[Column], Column]:
    return lambda value: F.call_function(name, value)


#: Functions of one text.
EXPRESSIONS: dict[str, Callable[[Column], Column]] = {
    "classify_url": urls.classify_url,
    "base_name": names.base_name,
    "file_extension": names.file_extension,
    "file_stem": names.file_stem,
    "all_extensions": names.all_extensions,
    "normalize_extension": names.normalize_extension,
    "canonical_extension": names.canonical_extension,
    "mime_for_extension": names.mime_for_extension,
    "nested_archive": paths.nested_archive,
    "filename_findings": names.filename_findings,
    "sanitize_filename": lambda value: names.sanitize_filename(value, nfkc=_named("assay_nfkc")),
}
#: Python functions that bodies call by name, as Spark has no SQL text for their calls.
HELPERS = {"assay_nfkc": names._nfkc, "assay_zip_lists": containers._zip_lists, "assay_ole_lists": containers._ole_lists, "assay_inflated_start": containers._inflated_start}

_TOKEN = re.compile(r"'(?:[^'\\]|\\.)*'|`[^`]*`|[A-Za-z_]\w*\(|[(),]|[^'`(),A-Za-z_]+|[A-Za-z_]\w*", re.S)
#: Functions whose names SQL reads as operators unless they are quoted.
_OPERATORS = ("and", "or", "not", "in", "like", "rlike", "div", "between", "case", "when", "if")


def lambdas_as_sql(text: str) -> str:
    """An expression's text with calls of lambdafunction(body, variables) as SQL writes them."""
    frames: list[tuple[str, list[str]]] = [("", [""])]  # of each open bracket: what stands before it, and its parts
    for token in _TOKEN.findall(text):
        if token.endswith("(") and token[0] not in "'`":
            frames.append((token[:-1], [""]))
        elif token == ")":
            name, parts = frames.pop()
            if name == "lambdafunction":
                variables = ", ".join(p.strip() for p in parts[1:])
                done = f"{variables if len(parts) == 2 else f'({variables})'} -> {parts[0]}"
            else:
                done = f"{f'`{name}`' if name in _OPERATORS else name}({','.join(parts)})"
            frames[-1][1][-1] += done
        elif token == "," and len(frames) > 1:
            frames[-1][1].append("")
        else:
            frames[-1][1][-1] += token
    return frames[0][1][0]


def sql_text(spark: SparkSession, column: Column, arguments: dict[str, str]) -> str:
    """The SQL text of an expression over arguments (names and types)."""
    row = spark.range(1).select(*[F.lit(None).cast(kind).alias(name) for name, kind in arguments.items()])
    return lambdas_as_sql(row.select(column.alias("_"))._jdf.queryExecution().logical().expressions().head().child().sql())


def declare(spark: SparkSession, name: str, column: Column, **arguments: str) -> None:
    """Make an expression a temporary function of Spark SQL."""
    takes = ", ".join(f"{a} {kind}" for a, kind in arguments.items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURN {sql_text(spark, column, arguments)}")


class ArchiveEntries:
    """archive_entries(payload_id, kind, content): the rows of one archive, as operators.archive lists them."""

    def eval(self, payload_id: str, kind: str, content: bytes):
        if kind is None or content is None:
            return
        limits = archive.ArchiveLimits()
        rows = archive.list_zip(payload_id, content, limits)[0] if kind == "zip" else archive.list_stream(payload_id, content, kind, limits)
        for row in rows:
            yield tuple(row.get(c) for c in archive.COLUMNS)


class SvgNodes:
    """svg_nodes(payload_id, content): the elements of one SVG file, as operators.svg lists them."""

    def eval(self, payload_id: str, content: bytes):
        if content is None:
            return
        for row in svg.list_nodes(payload_id, content, svg.SvgPolicy().max_depth):
            yield tuple(row.get(c) for c in svg.COLUMNS)


def _type_of(content: Column, inside: dict[str, Column]) -> Column:
    """detected, of a content and what its containers hold."""
    prolog = lambda t: F.when(left_trimmed(t).startswith("<"), markup_prolog(t))
    text = let(F.when(F.octet_length(content) > 0, head_text(F.substring(content, 1, HEAD))), lambda t: let(prolog(t), lambda p: text_kind(t, p)))
    return kind_struct(F.coalesce(binary_kind(content, **inside), text))


def register(spark: SparkSession) -> list[str]:
    """Create temporary SQL functions from the expressions, and table functions over single files; returns their names.

    detect_type(content) is the struct that functions.detect gives a payload,
    embedded_formats(content, detected) the findings about formats inside.  The session's batches
    for Python are small from then on, unless it has a size of its own (functions.ship.small_batches).
    """
    ship(spark)
    small_batches(spark)
    for name, helper in HELPERS.items():
        spark.udf.register(name, helper)
    for name, build in EXPRESSIONS.items():
        declare(spark, name, build(F.col("value")), value="string")
    content = F.col("content")
    inside = {"zip_kind": containers.zip_kind(content, read=_named("assay_zip_lists")), "ole_kind": containers.ole_kind(content, read=_named("assay_ole_lists")), "gzip_kind": containers.gzip_kind(content, read=_named("assay_inflated_start"))}
    for name, column in inside.items():  # by themselves, as no lambda may call Python
        declare(spark, f"assay_{name}", column, content="binary")
    declare(spark, "assay_type", _type_of(content, {n: F.col(n) for n in inside}), content="binary", **dict.fromkeys(inside, "string"))
    calls = ", ".join(f"assay_{n}(content)" for n in inside)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION detect_type(content BINARY) RETURN assay_type(content, {calls})")
    declare(spark, "embedded_formats", polyglot.embedded(content, F.col("detected")), content="binary", detected=DETECTED)
    spark.udtf.register("archive_entries", udtf(ArchiveEntries, returnType=archive.ENTRY))
    spark.udtf.register("svg_nodes", udtf(SvgNodes, returnType=svg.NODE))
    return [*EXPRESSIONS, "detect_type", "embedded_formats", "archive_entries", "svg_nodes"]
