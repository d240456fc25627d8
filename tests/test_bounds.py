"""What a task's Python holds follows a fixed bound and not the number of rows of a batch."""

import gzip

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.util import PythonEvalType

from assay import wrapped
from assay.functions.detect import with_kind
from assay.functions.ship import BATCH, TOGETHER
from assay.operators import archive, containers
from assay.plans import guard, sql
from assay.sources import ranged


def test_files_are_built_a_bounded_number_of_bytes_at_a_time():
    bodies = [bytes([i]) * 300_000 for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array(bodies, pa.binary())], names=["doc_id", "body"])
    out = list(wrapped.built_batches(iter([batch]), lambda k, body: (f"{k}.bin", body)))
    assert max(b.nbytes for b in out) < wrapped.TOGETHER + 400_000 and len(out) >= 10
    rows = [r for b in out for r in b.to_pylist()]
    assert rows == [{"payload_id": str(k), "filename": f"{k}.bin", "content": body} for k, body in enumerate(bodies)]


def test_lists_inside_are_read_from_arrow_without_a_copy_of_the_batch():
    files = [w.build(b"text") for w in wrapped.WRAPS]
    zips = pa.array([f if f.startswith(b"PK") else None for f in files], pa.binary())
    found = containers._zip_lists.func(zips)
    assert isinstance(found, pa.Array) and [x["names"] for x in found.to_pylist()] == [None if not z.is_valid else containers._zip_list(z.as_py())[0] for z in zips]
    ole = pa.array([wrapped.compound("Workbook", b"x"), None], pa.binary())
    assert containers._ole_lists.func(ole).to_pylist() == [["Root Entry", "Workbook"], None]
    assert containers._inflated_start.func(pa.array([gzip.compress(b"abc"), b"no gzip", None], pa.binary())).to_pylist() == [b"abc", None, None]


def test_gzip_files_are_unpacked_a_bounded_number_of_bytes_at_a_time():
    files = [gzip.compress(bytes(500_000))] * 30 + [gzip.compress(bytes(900_000)), b"no gzip", None]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(33)]), pa.array(files, pa.binary())], names=["payload_id", "content"])
    out = list(guard.unpacked_batches(iter([batch]), 600_000))
    assert max(b.nbytes for b in out) < guard.TOGETHER + 600_000
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["payload_id"] for r in rows] == [str(i) for i in range(33)]
    assert [None if r["content"] is None else len(r["content"]) for r in rows] == [500_000] * 30 + [None] * 3


def test_entries_of_many_archives_are_handed_on_together():
    data = wrapped.zipped(("a", b"1"), ("b", b"2"))
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(1500)]), pa.array(["zip"] * 1500), pa.array([data] * 1500, pa.binary())], names=["k", "kind", "content"])
    out = list(archive.entry_batches(iter([batch]), archive.ArchiveLimits(), False))
    assert [b.num_rows for b in out] == [1002, 1002, 1002, 1002, 492]  # a container and two entries each, never cut
    assert [(r["payload_id"], r["idx"]) for b in out for r in b.to_pylist()] == [(str(i), k) for i in range(1500) for k in (-1, 0, 1)]


def test_names_count_among_what_located_files_hold():
    row = {"payload_id": "p", "path": "p", "filename": "p", "size": 1, "oversized": False, "content": b"", "listed": {"names": ["n" * 1000] * 500, "mimetype": None}}
    out = list(ranged.located_batches(iter([row, None] * 20)))
    assert sum(b.num_rows for b in out) == 20 and max(b.num_rows for b in out) <= 3


def test_sql_functions_read_containers_from_arrow():
    assert {sql.HELPERS[n].evalType for n in ("assay_zip_lists", "assay_ole_lists", "assay_inflated_start")} == {PythonEvalType.SQL_SCALAR_ARROW_UDF}


@F.arrow_udf(T.LongType())
def _handed(contents: pa.Array) -> pa.Array:
    return pa.array([contents.nbytes] * len(contents), pa.int64())


def test_payloads_are_handed_to_sql_functions_a_few_bytes_at_a_time(spark):
    session = spark.newSession()
    sql.register(session)
    session.udf.register("handed", _handed)
    rows = session.range(0, 64, 1, 1).select(F.repeat(F.lit("x"), 1 << 18).cast("binary").alias("content"))
    rows.createOrReplaceTempView("payloads")
    assert session.sql("SELECT max(handed(content)) FROM payloads").first()[0] <= 1.25 * TOGETHER
    seen = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long")
    assert seen.agg(F.max("n")).first()[0] <= 1.25 * TOGETHER


def test_detection_makes_batches_small_but_keeps_a_size_that_was_set(spark):
    for given, kept in ((None, str(TOGETHER)), ("16m", "16m")):
        session = spark.newSession()
        if given:
            session.conf.set(BATCH, given)
        with_kind(session.createDataFrame([("p", bytearray(b"x"))], "payload_id string, content binary"))
        assert session.conf.get(BATCH) == kept
