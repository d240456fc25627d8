"""Small building blocks: byte arithmetic, findings, literal maps."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FINDING = "struct<code:string,severity:int,message:string,detail:map<string,string>,remediated:boolean>"
INFO, LOW, MEDIUM, HIGH, CRITICAL = 0, 10, 20, 30, 40
SEVERITIES = {INFO: "INFO", LOW: "LOW", MEDIUM: "MEDIUM", HIGH: "HIGH", CRITICAL: "CRITICAL"}
#: White space as Unicode text has it, for Java patterns: (?U)\\s lacks the four separators.
SPACE = r"[\s\x1c-\x1f]"


def part(content: Column, offset: int, size: int) -> Column:
    """size bytes from a 0-based offset; fewer, or none, past the end."""
    return F.substring(content, offset + 1, size)


def number(data: Column, size: int) -> Column:
    """Bytes as an unsigned big-endian number; null unless there are `size` of them."""
    return F.when(F.octet_length(data) == size, F.conv(F.hex(data), 16, 10).cast("long"))


def big(content: Column, offset: int, size: int) -> Column:
    return number(part(content, offset, size), size)


def little(content: Column, offset: int, size: int) -> Column:
    """An unsigned little-endian number; null past the end."""
    digits = F.hex(part(content, offset, size))
    swapped = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))])
    return F.when(F.length(digits) == 2 * size, F.conv(swapped, 16, 10).cast("long"))


def latin(content: Column) -> Column:
    """Bytes as characters 0 to 255, one for each."""
    return F.decode(content, "ISO-8859-1")


def literal_map(pairs: dict[str, str]) -> Column:
    """A map of texts without tabs and line feeds; one text for all, as each literal is a call to the JVM."""
    return F.str_to_map(F.lit("\n".join(f"{k}\t{v}" for k, v in pairs.items())), F.lit("\n"), F.lit("\t"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def finding(when: Column, code, severity, message, detail: dict[str, Column] | None = None, remediated: Column | None = None) -> Column:
    """A finding where the condition holds, else null.  Detail values are written as JSON would write them."""
    plain = {n: v for n, v in (("code", code), ("severity", severity), ("message", message)) if not isinstance(v, Column)}
    if len(plain) == 3 and not detail and remediated is None:
        return F.when(when, F.from_json(F.lit(json.dumps({**plain, "detail": {}, "remediated": False})), FINDING))
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    pairs = [x for k, v in (detail or {}).items() for x in (F.lit(k), v.cast("string"))]
    # no cast to FINDING: Spark leaves casts to structs out of SQL text
    fields = {"code": as_column(code), "severity": as_column(severity), "message": as_column(message), "detail": F.create_map(*pairs) if pairs else F.from_json(F.lit("{}"), "map<string,string>"), "remediated": F.lit(False) if remediated is None else remediated}
    return F.when(when, F.struct(*[v.alias(k) for k, v in fields.items()]))


def let(value: Column, body) -> Column:
    """body(value), with value worked out once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def held(value: Column) -> Column:
    """value, behind a condition that always holds but is not deterministic to the optimizer.

    Filters on a column that is held are not pushed below it; pushed down, a filter repeats
    the whole expression, and every expression that this one refers to, once for each use.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def findings(*each: Column) -> Column:
    """The findings that are there, in this order."""
    return F.filter(F.array(*each), lambda f: f.isNotNull())


def no_findings() -> Column:
    return F.from_json(F.lit("[]"), f"array<{FINDING}>")
