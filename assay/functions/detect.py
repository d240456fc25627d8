"""The type of a payload: from its bytes, else from its text, else unknown."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.binary import binary_kind
from assay.functions.registry import HEAD, KINDS, UNKNOWN
from assay.functions.ship import small_batches
from assay.functions.text import head_text, left_trimmed, markup_prolog, text_kind

DETECTED = "struct<mime:string,extensions:array<string>,description:string,category:string>"


def kind_struct(key: Column) -> Column:
    """struct<mime, extensions, description, category> of a type's key; null is the unknown type.

    The types come as one JSON text, which the optimizer turns into a literal map: column
    by column they would be thousands of calls to the JVM for each plan.
    """
    whole = lambda k: {"mime": k.mime, "extensions": list(k.extensions), "description": k.description, "category": k.category}
    kinds = F.from_json(F.lit(json.dumps({k.key: whole(k) for k in KINDS.values()})), f"map<string,{DETECTED}>")
    return F.coalesce(F.try_element_at(kinds, key), F.from_json(F.lit(json.dumps(whole(UNKNOWN))), DETECTED))


def with_kind(payloads: DataFrame, content: str = "content", to: str = "kind", containers: bool = True) -> DataFrame:
    """payloads with the key of each one's type.

    With containers, ZIP, OLE2 and gzip files are looked into; only such rows leave the JVM.
    Located payloads (sources.ranged) bring the names inside along, and content is their beginning.
    """
    body = F.col(content)
    listed, streams = (F.col(c) if c in payloads.columns else None for c in ("listed", "streams"))
    inside = {}
    if containers:
        from assay.operators.containers import gzip_kind, ole_kind, zip_kind

        small_batches(payloads.sparkSession)
        payloads = payloads.withColumn("_zip", zip_kind(body, listed)).withColumn("_ole", ole_kind(body, streams)).withColumn("_gzip", gzip_kind(body))
        inside = {"zip_kind": F.col("_zip"), "ole_kind": F.col("_ole"), "gzip_kind": F.col("_gzip")}
    by_bytes = payloads.withColumn("_bytes", binary_kind(body, **inside)).drop("_zip", "_ole", "_gzip")
    # the text of rows that bytes have settled is not looked at
    text = by_bytes.withColumn("_text", F.when(F.col("_bytes").isNull() & (F.octet_length(body) > 0), head_text(F.substring(body, 1, HEAD))))
    # a column of its own, so that it is worked out once
    parsed = text.withColumn("_prolog", F.when(left_trimmed(F.col("_text")).startswith("<"), markup_prolog(F.col("_text"))))
    return parsed.withColumn(to, F.coalesce("_bytes", text_kind(F.col("_text"), F.col("_prolog")))).drop("_bytes", "_text", "_prolog")


def detect(payloads: DataFrame, content: str = "content", containers: bool = True) -> DataFrame:
    """payloads with `detected`, the struct of each one's type."""
    return with_kind(payloads, content, "_kind", containers).withColumn("detected", kind_struct(F.col("_kind"))).drop("_kind")


def preferred_extension(detected: Column) -> Column:
    return F.try_element_at(detected["extensions"], F.lit(1))


def is_unknown(detected: Column) -> Column:
    return (detected["mime"] == UNKNOWN.mime) & (detected["category"] == "unknown")
