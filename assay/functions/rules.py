"""Rules about types as keys: what a type is known by, and what a rule asks for, are words of one kind.

A type has a word for its MIME type, for the family before the slash, for its category and
for each of its extensions in the usual spelling.  A rule is one such word, so a rule holds
for a type that has it.  A few rules are one look-up per word of a row's type; any number
of them is an equi-join with the words of the registry, whose outcome, the types that some
rule holds for, is never larger than the registry.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.names import canonical_extension
from assay.functions.registry import KINDS, UNKNOWN, canonical

#: Rules from which on a policy is checked by a join.
MANY = 64
_NAME = r"[\w!#$&^.+-]+"
# what a rule may look like, and the word it stands for
_SHAPES = (
    (re.compile(r"category:(.*)", re.S), lambda m: ("category", m[1].strip())),
    (re.compile(rf"({_NAME})/\*", re.A), lambda m: ("family", m[1])),
    (re.compile(rf"{_NAME}/{_NAME}", re.A), lambda m: ("mime", m[0])),
    (re.compile(r"[^/]+", re.S), lambda m: ("extension", canonical(m[0]))),
)


class Rule(NamedTuple):
    """`image/png`, `image/*`, `category:image` or `.png`, as the word that it asks for."""

    about: str
    value: str

    @property
    def word(self) -> str:
        return f"{self.about}={self.value}"


def rule(text: str) -> Rule:
    """The rule that text states; ValueError if it states none."""
    plain = text.strip().lower()
    for shape, read in _SHAPES:
        if found := shape.fullmatch(plain):
            about, value = read(found)
            if value or about == "category":
                return Rule(about, value)
            break
    raise ValueError(f"no rule about types: {text!r}")


def rules(of: str | Rule | Iterable[str | Rule] | None) -> list[Rule]:
    if of is None:
        return []
    each = [of] if isinstance(of, (str, Rule)) else of
    return [r if isinstance(r, Rule) else rule(r) for r in each]


def words(detected: Column) -> Column:
    """array<string>: the words of the struct detected(mime, extensions, category, ...)."""
    mime = F.lower(detected["mime"])
    told = {"mime": mime, "family": F.when(mime.contains("/"), F.substring_index(mime, "/", 1)), "category": detected["category"]}
    own = F.filter(F.array(*[F.concat(F.lit(f"{k}="), v) for k, v in told.items()]), lambda w: w.isNotNull())
    return F.concat(own, F.transform(detected["extensions"], lambda e: F.concat(F.lit("extension="), canonical_extension(e))))


def holds(asked: Iterable[Rule], detected: Column) -> Column:
    """Whether one of a few rules holds for a type."""
    wanted = sorted({r.word for r in asked})
    return F.exists(words(detected), lambda w: w.isin(*wanted)) if wanted else F.lit(False)


_TYPE = ["mime", "category", "extensions"]


def types_frame(spark: SparkSession) -> DataFrame:
    """(mime, category, extensions) of all types of the registry, and the unknown one."""
    rows = {(k.mime, k.category, tuple(k.extensions)) for k in [*KINDS.values(), UNKNOWN]}
    return spark.createDataFrame([(m, c, list(e)) for m, c, e in sorted(rows)], "mime string, category string, extensions array<string>")


def rules_frame(spark: SparkSession, asked: Iterable[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.word,) for r in asked], "word string").distinct()


def types_covered(asked: DataFrame) -> DataFrame:
    """The types of the registry that a rule of (word) holds for; the rules may be any number, the registry side is small and goes to them."""
    types = types_frame(asked.sparkSession)
    each = types.select(*_TYPE, F.explode(words(F.struct(*_TYPE))).alias("word"))
    return asked.join(F.broadcast(each), "word").select(*_TYPE).distinct()


def with_rules(rows: DataFrame, asked: list[Rule] | DataFrame, to: str, detected: str = "detected") -> DataFrame:
    """rows with a boolean column: whether a rule holds for the type, one of the registry, in `detected`.  Rows may be a stream."""
    found = types_covered(asked if isinstance(asked, DataFrame) else rules_frame(rows.sparkSession, asked))
    marked = F.broadcast(found.select(F.struct(*_TYPE).alias("_type"), F.lit(True).alias(to)))  # at most the registry
    own = rows.withColumn("_type", F.struct(*[F.col(f"{detected}.{c}").alias(c) for c in _TYPE]))
    return own.join(marked, "_type", "left").drop("_type").withColumn(to, F.coalesce(to, F.lit(False)))


def covered(rows: DataFrame, asked: list[Rule] | DataFrame, detected: str = "detected", how: str = "left_semi") -> DataFrame:
    """The rows that a rule holds for; how='left_anti': the others."""
    found = types_covered(asked if isinstance(asked, DataFrame) else rules_frame(rows.sparkSession, asked))
    types = F.broadcast(found.select(F.struct(*_TYPE).alias("_type")))
    own = F.struct(*[F.col(f"{detected}.{c}").alias(c) for c in _TYPE])
    return rows.withColumn("_own", own).join(types, F.col("_own") == F.col("_type"), how).drop("_own")
