"""Rules about types: what may be stated, and thousands of them against the plain answers."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from assay.functions import rules
from assay.functions.registry import KINDS, canonical
from assay.plans import guard
from assay.plans.policy import Policy
from assay.sources.payloads import from_bytes


@pytest.mark.parametrize("text, word", [(" Image/* ", "family=image"), ("application/PDF", "mime=application/pdf"), (".JPEG", "extension=jpg"), ("docx", "extension=docx"), ("category: Script", "category=script"), ("tar.gz", "extension=tgz"), ("x/y+z.w", "mime=x/y+z.w")])
def test_what_a_rule_stands_for(text, word):
    assert rules.rule(text).word == word and rules.rules(text) == rules.rules([rules.rule(text)])


@pytest.mark.parametrize("text", ["", " ", ".", "a/", "/b", "a/b/c", "*/*", "image/**", "é/x"])
def test_what_is_no_rule(text):
    with pytest.raises(ValueError):
        rules.rule(text)
    with pytest.raises(ValueError):
        Policy(allowed=[text])


def plain(kind, asked) -> bool:
    """One type against each rule in turn."""
    told = {f"mime={kind.mime.lower()}", f"family={kind.mime.split('/')[0]}", f"category={kind.category}", *(f"extension={canonical(e)}" for e in kind.extensions)}
    return any(r.word in told for r in asked)


def test_thousands_of_rules_answer_like_few(spark):
    rng = random.Random(2)
    pool = [f"{rng.choice('abcdef')}{i}/x" for i in range(4_000)] + [f"category:c{i}" for i in range(2_000)] + [f".e{i}" for i in range(3_990)] + ["image/*", "application/zip", ".docx", "category:font", ".tar.gz", ".mp3"]
    asked = rules.rules(pool)
    kinds = list(KINDS.values())
    rows = spark.createDataFrame([(k.key, (k.mime, list(k.extensions), k.description, k.category)) for k in kinds] * 2, "key string, detected struct<mime:string,extensions:array<string>,description:string,category:string>")
    got = rules.with_rules(rows, asked, "held").select("key", "held").collect()
    assert {(r["key"], r["held"]) for r in got} == {(k.key, plain(k, asked)) for k in kinds} and len(got) == 2 * len(kinds)
    few = asked[-6:]
    assert {(r["key"], r["h"]) for r in rows.select("key", rules.holds(few, F.col("detected")).alias("h")).collect()} == {(k.key, plain(k, few)) for k in kinds}
    table = rules.rules_frame(spark, asked)
    inside, outside = (sorted(r["key"] for r in rules.covered(rows, table, how=how).collect()) for how in ("left_semi", "left_anti"))
    assert inside == sorted(2 * [k.key for k in kinds if plain(k, asked)]) and outside == sorted(2 * [k.key for k in kinds if not plain(k, asked)])
    assert rules.covered(rows, []).count() == 0
    plan = rules.with_rules(rows, table, "held")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_policies_with_many_rules(spark):
    policy = Policy(allowed=["text/plain", *(f".x{i}" for i in range(rules.MANY))], blocked=[f"category:y{i}" for i in range(rules.MANY + 1)] + [".png"])
    files = from_bytes(spark, [("a.txt", b"prose"), ("b.png", b"\x89PNG\r\n\x1a\n" + bytes(20) + b"IEND\xae\x42\x60\x82")])
    got = {r["filename"]: {f["code"] for f in r["findings"]} for r in guard.scan_simple(files, policy).collect()}
    assert got == {"a.txt": set(), "b.png": {"type.blocked", "type.not_allowed"}}
