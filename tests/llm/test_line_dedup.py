from __future__ import annotations

import hashlib


from assay.llm import line_dedup
from assay.llm.queries import op4_line_dedup


def plain(rows: list[tuple]) -> list[tuple]:
    """(doc_id, n_lines, n_removed, removed, sha256) by a dictionary of windows; rows (doc_id, text), repeated ones alike."""
    first, out = {}, []
    distinct = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    for k, text in distinct:
        lines = text.split("\n")
        for i in range(len(lines) - 2):
            first.setdefault("\n".join(lines[i : i + 3]), (k, text, i))
    for k, text in rows:
        lines = [] if text is None else text.split("\n")
        gone = sorted({j for i in range(len(lines) - 2) if first["\n".join(lines[i : i + 3])] != (k, text, i) for j in range(i, i + 3)})
        runs = [(a, next(b for b in range(a, len(lines) + 1) if b not in gone)) for a in gone if a - 1 not in gone]
        kept = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        out.append((k, len(lines), len(gone), ",".join(f"{a}:{b}" for a, b in runs), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_query_is_a_dictionary_of_windows(spark, sf_dir, table):
    want = plain(list(zip(table.doc_id, table.text, strict=True)))
    assert sorted(map(str, (tuple(r) for r in op4_line_dedup(spark, sf_dir).collect()))) == sorted(map(str, want))
    assert sum(w[2] for w in want) >= 16


def test_overlapping_repeats_within_a_document(spark):
    text = "\n".join("a b c d a b c d x a b c".split())
    df = spark.createDataFrame([(1, text), (2, "q\nb\nc\nd\nz"), (3, None), (4, "a\nb")], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], [tuple(x) for x in r["removed"]], r["n_lines"]) for r in line_dedup.dedup(df).collect()}
    assert got == {1: ("\n".join("a b c d x".split()), [(4, 8), (9, 12)], 12), 2: ("q\nz", [(1, 4)], 5), 3: (None, [], 0), 4: ("a\nb", [], 2)}


def test_time_follows_the_length_of_a_text(spark):
    n = 200_000
    text = "\n".join(f"{i}\na\nb\nc" for i in range(n))
    got = line_dedup.dedup(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got["n_lines"] == 4 * n and len(got["removed"]) == n - 1 and tuple(got["removed"][-1]) == (4 * n - 3, 4 * n)
    assert got["text"] == "\n".join(["0", "a", "b", "c", *map(str, range(1, n))])


def test_columns_stay_and_no_python_runs(spark, docs, sf_dir, empty_dir):
    found = line_dedup.dedup(docs)
    assert found.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_removed", "removed"]
    assert found.count() == docs.count()
    plan = op4_line_dedup(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert op4_line_dedup(spark, empty_dir).count() == 0
