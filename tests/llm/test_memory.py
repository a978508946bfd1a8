"""Python workers, which outlive their tasks, give back what tasks have freed."""

from __future__ import annotations

import pyarrow as pa

from ssaflow.llm import common, simhash, toxicity


def _functions():
    """resident_mb, of this process; hungry, a task that frees all it takes but every hundredth piece, so that nothing
    goes back by itself."""
    kept: list = []

    def resident_mb():
        import os

        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") // 1_000_000

    def hungry(it):
        for batch in it:
            pieces = [bytes(50_000) + bytes([k % 7]) for k in range(4_000)]
            kept.extend(pieces[::100])
            del pieces
            yield batch

    return resident_mb, hungry


def test_freed_memory_goes_back():
    resident_mb, hungry = _functions()
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2])], ["x"])
    before = resident_mb()
    assert list(common.lean(hungry)(iter([batch]))) == [batch]
    assert resident_mb() - before < 60


def test_operators_tasks_are_lean(spark, monkeypatch):
    seen = []
    for module in (simhash, toxicity):
        monkeypatch.setattr(module, "lean", lambda run: seen.append(run) or common.lean(run))
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id bigint, text string")
    assert simhash.fingerprints(docs).count() == 2 and len(seen) == 1
    assert simhash.shingle_rows(docs, 0.8, 5).count() == 2 and len(seen) == 3
    model = toxicity.ToxicityModel({}, None, None, 0.0, ([], []))
    assert toxicity.reject(docs, model).count() == 2 and len(seen) == 4


def test_the_driver_gives_back_on_release(spark):
    resident_mb, hungry = _functions()
    before = resident_mb()
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2])], ["x"])
    assert list(hungry(iter([batch]))) == [batch]
    common.release(spark)
    assert resident_mb() - before < 60
