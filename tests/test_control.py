"""The control plane, files, streams and the command line."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ssaflow import workflows as W
from ssaflow.__main__ import main
from ssaflow.engine import Engine
from ssaflow.operators import control
from ssaflow.plans import ir
from ssaflow.service import Orchestrator
from ssaflow.sources.bundles import Manifest, build, bundle, ddl_of, load_bundle, load_manifest, load_project
from ssaflow.streaming.micro import WorkQueue, run_stream, running_state

#: Fixed value: a bundle in the portable form, which must load as it is.
BUNDLE = """{"id": "add_workflow", "version": "0.1.0", "ir": {"name": "add_workflow", "operations": [{"literals": [{"output": 0, "value": "1"},
 {"output": 1, "value": "2"}], "phis": [], "call": {"task_id": "add", "inputs": [0, 1], "outputs": [2]}, "next": {"Return": {"var": 2}}}]},
 "task_versions": {"add": "0.1.0"}}"""


def test_upserts(spark):
    t = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, n int, s string")
    out = control.upsert(t, spark.createDataFrame([("b", 5), ("c", 6)], "k string, n int"), ["k"])
    assert sorted(map(tuple, out.collect())) == [("a", 1, "x"), ("b", 5, "y"), ("c", 6, None)]
    out = control.insert_if_absent(t, spark.createDataFrame([("b", 9, "z"), ("d", 7, None)], t.schema), ["k"])
    assert sorted((r.k, r.n) for r in out.collect()) == [("a", 1), ("b", 2), ("d", 7)]
    rows = spark.createDataFrame([("a", 1), ("a", 3), ("a", 2)], "k string, n int")
    assert control.upsert_last(rows, ["k"], ["n"]).first().n == 3
    assert control.insert_first(rows, ["k"], ["n"]).first().n == 1


def test_node_life(spark):
    tables = control.create_tables(spark)
    late = spark.createDataFrame([("n", "r", 1, 0, "running", datetime(2020, 1, 1))], "id string, run_id string, op_id int, ctx_id int, status string, lease_expires_at timestamp")
    nodes = control.upsert_run_node(tables["run_nodes"], late)
    assert control.expired_leases(nodes).count() == 1
    assert control.sweep_leases(nodes).first().status == "failed"
    nodes = control.update_run_node(nodes, "r", 1, 0, "succeeded")
    assert control.expired_leases(nodes).count() == 0 and control.count_by_status(nodes, "r", "succeeded") == 1
    ctx = control.create_context(tables["contexts"], spark.createDataFrame([(0, "r", None, "active", None)], control.TABLES["contexts"]))
    assert control.complete_status(ctx, nodes).first().status == "running"
    assert control.complete_status(control.finish_context(ctx, "r", 0), nodes).first().status == "succeeded"
    assert control.complete_status(control.finish_context(ctx, "r", 0), control.update_run_node(nodes, "r", 1, 0, "failed", "x")).first().status == "partial_failed"


def test_ancestors(spark):
    spark.createDataFrame([("r", 0, None), ("r", 1, 0), ("r", 2, 1), ("r", 3, 0)], "run_id string, id int, parent_ctx_id int").createOrReplaceTempView("ctx_view")
    spark.createDataFrame([("r", 0, 7, "root"), ("r", 1, 7, "one"), ("r", 3, 8, "other")], "run_id string, ctx_id int, value_id int, value string").createOrReplaceTempView("val_view")
    out = {r.ctx_id: r.value for r in control.ancestor_values(spark, "ctx_view", "val_view", 7).collect()}
    assert out == {0: "root", 1: "one", 2: "one", 3: "root"}


def test_pools_and_hashes(spark):
    assert control.normal_pool("  GPU ") == "gpu"
    with pytest.raises(ValueError):
        control.normal_pool("cpu")
    row = spark.createDataFrame([("abc",)], "t string").select(
        control.input_hash(F.col("t")).alias("h"), control.object_key(F.col("t")).alias("o"), control.fits_inline(F.col("t"), 3).alias("i"), control.fits_inline(F.col("t"), 0).alias("z"), control.valid_pool(F.lit(" Wasm")).alias("v"),
    ).first()
    assert row.h.startswith("sha256:ba7816bf") and row.o == f"values/{row.h}.json" and row.i and not row.z and row.v


def test_manifests_and_bundles(spark, tmp_path):
    good = Manifest("add", "0.1.0", "single", "trusted", "native")
    assert load_manifest(good.to_json()) == good and good.pool() == "trusted" and not good.problems()
    assert len(Manifest("x", "1", "single", "untrusted", "native", requires_gpu=True).problems()) == 2
    with pytest.raises(ValueError):
        Manifest("x", "1", "single", "nobody", "native")
    made = load_bundle(BUNDLE)
    assert load_bundle(made.to_json()) == made
    assert Engine(spark).run(made.ir).values() == [3]
    with pytest.raises(KeyError):
        bundle(made.ir, "1", {})
    assert ddl_of({"type": "array", "items": [{"type": "integer"}, {"type": "boolean"}]}) == "struct<_0:bigint,_1:boolean>"
    assert ddl_of({"type": "array", "items": {"type": "string"}}) == "array<string>" and ddl_of({}) == "variant"
    (tmp_path / "p.toml").write_text('[project]\nname = "p"\n[tasks.add]\nversion = "0.2"\nkind = "single"\nruntime = "native"\ntrust = "trusted"\n[workflows]\nexport = "auto"\n[workflows.simple]\nversion = "3"\n[build]\nout_dir = "out"\n')
    paths = build(load_project(str(tmp_path / "p.toml")), {"simple": W.simple.ir})
    assert len(paths) == 2 and load_bundle(open(paths[1]).read()).task_versions == {"add": "0.2"}


def test_orchestrator(spark):
    o = Orchestrator(spark)
    o.upload_task(Manifest("add", "0.1.0", "single", "trusted", "native"))
    with pytest.raises(ValueError):
        o.upload_task(Manifest("bad", "1", "single", "untrusted", "native"))
    assert o.get_manifest("add", "0.1.0")["task_id"] == "add"
    with pytest.raises(KeyError):
        o.get_manifest("add", "9")
    o.register_worker("w1", " Trusted", "cpu.small")
    assert json.loads(o.workers()[0]["labels_json"])["pool"] == "trusted"
    assert control.has_worker(o.table("workers"), "trusted", "cpu.small") and not control.has_worker(o.table("workers"), "gpu", "cpu.small")
    o.upload_workflow(load_bundle(BUNDLE))
    run_id = o.create_run("add_workflow", "0.1.0")
    assert o.run_status(run_id) == "succeeded" and o.run_status("other") == "unknown"
    assert o.run_progress(run_id) == (1, 1) and o.values(run_id).first().result == 3
    assert o.events(run_id, 1)[0]["kind"] == "finished" and o.expire_leases() == 0
    o.upload_workflow(bundle(W.media_pipeline.ir, "1", {t: "1" for t in W.media_pipeline.ir.task_ids()}))
    assert o.run_status(o.create_run("media_pipeline", "1")) == "partial_failed"


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(v,) for v in (1, 2, 4)], "v int").coalesce(1).write.parquet(source)
    for _ in range(2):
        # what was done isn't done again
        q = run_stream(Engine(spark), W.etl_even_arm, spark.readStream.schema("v int").parquet(source), str(tmp_path / "out"), str(tmp_path / "cp"), str(tmp_path / "err"), ["v"])
        q.awaitTermination()
    assert sorted((r.v, r.result) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 11), (2, 9), (4, 11)]


def test_queue(spark, tmp_path):
    queue = WorkQueue(spark, str(tmp_path / "q"))
    one = spark.createDataFrame([("r", 1, 0, "add", "1", [0, 1], 60000, None)], WorkQueue.SCHEMA)
    queue.push(one, "queue:trusted:cpu.small")
    queue.push(one.withColumn("op_id", F.lit(2)), "queue:gpu:cpu.small")
    seen = []
    for _ in range(2):
        queue.consume("queue:trusted:cpu.small", str(tmp_path / "cp"), lambda df, n: seen.extend(r.op_id for r in df.collect())).awaitTermination()
    assert seen == [1]


def test_state_across_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", 1.0), ("b", 5.0)], "k string, v double").coalesce(1).write.parquet(source)
    stream = running_state(spark.readStream.schema("k string, v double").parquet(source), "k", "v", lambda a, b: a + b, 0.0)

    def drain():
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    drain()
    spark.createDataFrame([("a", 2.0)], "k string, v double").coalesce(1).write.mode("append").parquet(source)
    drain()
    assert sorted((r.k, r.state) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 1.0), ("a", 3.0), ("b", 5.0)]


def test_command_line(spark, tmp_path, capsys):
    assert main(["version"]) == 0
    assert main(["explain", "simple"]) == 0
    assert main(["export", str(tmp_path)]) == 0
    (tmp_path / "b.json").write_text(BUNDLE)
    assert main(["run", str(tmp_path / "b.json")]) == 0
    assert '{"result":3}' in capsys.readouterr().out
    assert ir.loads((tmp_path / "fibonacci.workflow.ir.json").read_text()) == W.fibonacci.ir


def test_entry_without_the_training_data_part(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
