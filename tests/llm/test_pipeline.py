from __future__ import annotations

import shutil
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers

import corpus_pipeline
from assay.llm import language_id
from assay.llm.common import materialize
from tests.llm.test_line_dedup import plain as plain_lines
from tests.llm.test_near_copies import alike, plain_set
from tests.llm.test_secrets import spans
from tests.llm.test_simhash import near, plain, roots

ROOT = Path(__file__).resolve().parents[2]


def keyed(df) -> list[tuple]:
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=str)


def test_each_stage_against_a_plain_one(spark, docs, sf_dir):
    from tokenizers import Tokenizer

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "simhash_dedup", "secret_scan", "packing"]

    known = materialize(stages["language_id"](spark, docs, sf_dir))
    assert known.columns == docs.columns
    found = {(r["doc_id"], r["text"]): r for r in language_id.identify(docs.select("doc_id", "text"), language_id.build_profiles(docs)).collect()}
    assert {k for k in map(tuple, keyed(known))} == {k for k, r in found.items() if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.MIN_LANGUAGE_SCORE}
    assert {r["doc_id"] for r in known.collect()} >= set(range(120))  # prose stays

    lines = materialize(stages["line_dedup"](spark, known, sf_dir))
    assert lines.columns == docs.columns
    rows = keyed(known)
    by_row = {row: out for row, out in zip(rows, plain_lines(rows), strict=True)}
    assert sorted((str(k) for k, _ in keyed(lines))) == sorted(str(k) for (k, _), out in by_row.items() for _ in range(rows.count((k, _))) if out[2] < out[1])
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())

    single = materialize(stages["simhash_dedup"](spark, lines, sf_dir))
    assert single.columns == docs.columns
    # one document of each component of near fingerprints and of five-word shingles' similarity of 0.8: the least key, null keys last
    texts = keyed(lines)
    prints, sets = [plain(t) for _, t in texts], [plain_set(t) for _, t in texts]
    root = roots(range(len(texts)), lambda i, j: near(prints[i], prints[j]) or alike(sets[i], sets[j]))
    least = {}
    for i, (k, _) in enumerate(texts):
        least[root[i]] = min(least.get(root[i], (True, 0)), (k is None, k or 0))
    assert sorted((k is None, k or 0) for k, _ in keyed(single)) == sorted(least.values())

    clean = materialize(stages["secret_scan"](spark, single, sf_dir))
    assert clean.columns == docs.columns and clean.count() == single.count()
    assert not any(spans(t) for _, t in keyed(clean) if "[SECRET]" in t)

    packed = stages["packing"](spark, clean, sf_dir).collect()
    tokenizer, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for k, t in keyed(clean):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        want += [(str(k), i, zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for i, a in enumerate(range(0, len(ids), 4096))]
    assert sorted((str(r["doc_id"]), r["piece"], r["ids_crc32"]) for r in packed) == sorted(want)
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((str(r["doc_id"]), r["piece"], r["ids_crc32"]) for r in whole) == sorted(want)


def test_empty_table(spark, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).count() == 0


def test_the_rest_stands_without_this_folder(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "assay", tmp_path / "assay", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not [k for k in q if k.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
