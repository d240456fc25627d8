from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from assay.llm import secrets
from assay.llm.queries import op2_secret_scan

PLAIN = (
    ("assign", re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII), 6, 1),
    ("access", re.compile("AKIA[A-Z0-9]+"), 20, 0),
    ("hex", re.compile("[0-9a-f]+"), 24, 0),
)


def spans(text: str) -> list[tuple[int, int, str, int]]:
    return sorted((m.start(), i, kind, m.end()) for i, (kind, p, least, g) in enumerate(PLAIN) for m in p.finditer(text) if len(m[g]) >= least)


def joined(found) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in found)


def test_query_is_what_patterns_find(spark, sf_dir, table):
    want = []
    for k, text in zip(table.doc_id, table.text, strict=True):
        s = spans(text or "")
        want.append((k, *(sum(x[2] == kind for x in s) for kind in ("assign", "access", "hex")), hashlib.sha256(joined(s).encode()).hexdigest(), joined(s)))
    got = [tuple(r) for r in op2_secret_scan(spark, sf_dir).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert sum(w[1] for w in want) > 40


VERSIONS = "path string, content string"


def test_ledger_grows_by_unseen_pairs_only(spark, tmp_path):
    v1 = spark.createDataFrame([("a", "token=abcdefg"), ("b", "token=abcdefg"), ("c", None)], VERSIONS)
    ledger = secrets.Ledger(spark, str(tmp_path / "ledger"))
    ledger.scan(v1)
    assert ledger.rows().count() == 2  # one blob for two paths, and the empty one
    v2 = v1.unionByName(spark.createDataFrame([("d", "secret: 1234567")], VERSIONS))
    assert [r["spans"][0]["kind"] for r in secrets.scan_new(v2, ledger.rows()).collect()] == ["assign"]
    waiting = {r["path"]: r["spans"] for r in ledger.findings(v2).collect()}
    assert waiting["d"] is None and waiting["c"] == []
    again = secrets.Ledger(spark, str(tmp_path / "ledger"))  # another session finds what is stored
    again.scan(v2)
    again.scan(v2)
    assert again.rows().count() == 3
    assert sorted((r["path"], r["kind"], r["start"], r["end"]) for r in secrets.findings(again.findings(v2)).collect()) == [("a", "assign", 0, 13), ("b", "assign", 0, 13), ("d", "assign", 0, 15)]


def test_other_rules_are_another_version(spark, tmp_path):
    docs = spark.createDataFrame([("a", "token=abcdefg key-123")], VERSIONS)
    ledger = secrets.Ledger(spark, str(tmp_path / "ledger"))
    ledger.scan(docs)
    more = (*secrets.RULES, secrets.Rule("key", "key-", "[0-9]+", 3))
    assert secrets.rules_version(more) != secrets.rules_version()
    ledger.scan(docs, rules=more)
    assert [s["kind"] for s in ledger.findings(docs, rules=more).first()["spans"]] == ["assign", "key"]
    assert [s["kind"] for s in ledger.findings(docs).first()["spans"]] == ["assign"]


def test_time_follows_the_length_of_a_text(spark):
    n = 200_000
    docs = spark.createDataFrame([(1, "token=abcdefg \u2603 " * n), (2, None)], "doc_id long, text string")
    spans = secrets.scan_new(docs, content="text").orderBy(F.size("spans").desc()).first()["spans"]
    assert len(spans) == n and (spans[-1]["start"], spans[-1]["end"]) == (16 * (n - 1), 16 * (n - 1) + 13)
    assert secrets.redacted(docs).where("doc_id = 1").first()["text"] == "[SECRET] \u2603 " * n


def test_redaction_keeps_all_else(spark, docs, table):
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in secrets.redacted(docs).select("doc_id", "text").collect())
    want = []
    for k, text in zip(table.doc_id, table.text, strict=True):
        out, at = "", 0
        for a, _, _, b in spans(text or ""):
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        want.append((str(k), str(None if text is None else out + text[at:])))
    assert got == sorted(want)
    assert secrets.redacted(docs).columns == docs.columns


def test_plan_has_no_python_and_empty_tables_work(spark, sf_dir, empty_dir):
    plan = op2_secret_scan(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert op2_secret_scan(spark, empty_dir).count() == 0


def test_runs_at_the_same_time_count_once(spark, tmp_path):
    """Two runs that both began before the other had ended: each blob is in the ledger twice, and found once."""
    versions = spark.createDataFrame([("a", "token=abcdefgh"), ("b", "token=abcdefgh"), ("c", None)], "path string, content string")
    ledger = secrets.Ledger(spark, str(tmp_path / "ledger"))
    late = spark.createDataFrame(secrets.scan_new(versions, ledger.rows()).collect(), secrets.LEDGER)
    ledger.scan(versions)
    late.write.mode("append").partitionBy("rules").parquet(ledger.path)
    assert ledger.rows().count() == 4
    assert sorted((r["path"], len(r["spans"])) for r in ledger.findings(versions).collect()) == [("a", 1), ("b", 1), ("c", 0)]
    ledger.scan(versions)
    assert ledger.rows().count() == 4
