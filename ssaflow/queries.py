"""The catalogue of queries over the driver's tables, run through workflows and the control plane, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ssaflow import workflows as W
from ssaflow.engine import Engine
from ssaflow.operators import control

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def _int(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("int") for c in columns})


def _rows(workflow, table: str, key: str, column: str, param: str | None = None) -> Query:
    """A workflow over one integer column of a table, with the key of each row."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _table(spark, sf_dir, table, *{key, column}).withColumn("__in", F.col(column).cast("int"))
        return Engine(spark).run(workflow, df, [key], {param or workflow.ir.params[0][0]: "__in"}).results.drop("ctx_path")

    return query


def multi_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _int(_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), "o_custkey")
    out = Engine(spark).run(W.tagged, df, ["o_orderkey"]).results
    return out.select("o_orderkey", F.col("result.x").cast("bigint").alias("x"), F.col("result.y").alias("y"), F.col("result.z").alias("z"))


def branch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _int(_table(spark, sf_dir, "orders", "o_orderkey"), "o_orderkey")
    arms = Engine(spark).run(W.parity, df).results
    return arms.groupBy(F.col("result").alias("arm")).agg(F.count("*").alias("n"))


def while_fib(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark).run(W.fibonacci).results


def while_if_collatz(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "supplier", "s_suppkey").where("s_suppkey > 0").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").cast("int").alias("n"))
    return Engine(spark).run(W.collatz, df, ["id"]).results.withColumn("result", F.col("result").cast("bigint"))


def while_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "part", "p_partkey", "p_size")
    return Engine(spark).run(W.while_rows, df, ["p_partkey"]).results.withColumnRenamed("p_partkey", "id")


def _leaf_failures(spark: SparkSession, sf_dir: str):
    df = _table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey")
    return Engine(spark).run(W.media_on_rows, df, ["l_orderkey", "l_linenumber", "l_suppkey"], {"n_nationkey": "l_linenumber"})


def leaf_failure_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaf_failures(spark, sf_dir).results.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("result"))


def leaf_failure_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaf_failures(spark, sf_dir).errors.where("message = 'intentional failure'").groupBy("message").agg(F.count("*").alias("n"))


def media_on_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark).run(W.media_on_rows, _table(spark, sf_dir, "nation", "n_nationkey")).results


def structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _rows(W.structured, "nation", "n_nationkey", "n_regionkey")(spark, sf_dir)
    return out.select("n_nationkey", F.col("result.value").alias("value"))


def unit_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _rows(W.unit_result, "nation", "n_nationkey", "n_regionkey")(spark, sf_dir)
    return out.select("n_nationkey", F.col("result").isNull().alias("unit"))


def ordered_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts by their paths: the place of each result among its root's."""
    from pyspark.sql import Window

    df = _table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    out = Engine(spark).run(W.ordered_contexts, df, ["n_nationkey"], {"v": "n_regionkey"}).results
    place = F.row_number().over(Window.partitionBy("n_nationkey").orderBy("ctx_path"))
    return out.select("n_nationkey", place.cast("bigint").alias("place"), "result", F.slice("ctx_path", 1, F.size("ctx_path") - 1)[0].alias("parent"))


def run_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.run_progress(_table(spark, sf_dir, "events", "user_id", "event_type"), "user_id", F.col("event_type") == "purchase")


def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.run_status(_table(spark, sf_dir, "events", "user_id", "event_type"), "user_id", F.col("event_type") == "error")


def upsert_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events", "user_id", "event_type", "value", "ts", "event_id")
    return control.upsert_last(events, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "value")


def insert_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events", "user_id", "event_type", "event_id", "ts")
    return control.insert_first(events, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


def expired_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events", "event_id", "event_type", "ts")
    nodes = events.select(F.col("event_id").alias("run_id"), F.lit(0).alias("op_id"), F.lit(0).alias("ctx_id"), F.when(F.col("event_type") == "click", "running").alias("status"), F.col("ts").alias("lease_expires_at"))
    return control.expired_leases(nodes, F.expr("timestamp_ntz '2024-01-15 00:00:00'")).select(F.col("run_id").alias("event_id"))


def has_worker_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events", "event_id", "event_type", "props")
    return events.where((F.col("event_type") == "view") & (F.get_json_object("props", "$.k") == "29")).select("event_id")


def newest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.read_events(_table(spark, sf_dir, "events", "event_id", "ts"), ["ts", "event_id"])


def distinct_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.distinct_tasks(_table(spark, sf_dir, "events", "event_type"), "event_type")


def missing_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = _table(spark, sf_dir, "orders", "o_orderkey"), _table(spark, sf_dir, "lineitem", "l_orderkey")
    return control.missing_versions(orders, lines, F.col("o_orderkey") == F.col("l_orderkey"))


def pool_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part", "p_partkey", "p_size")
    trust = F.when(F.col("p_size") > 25, "trusted").when(F.col("p_size") > 10, "restricted").otherwise("untrusted")
    return part.select("p_partkey", control.route_pool(F.col("p_size") > 40, trust).alias("pool"))


def input_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", control.input_hash(F.col("text")).alias("h"))


def inline_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.inline_groups(_table(spark, sf_dir, "documents", "source", "text"), "source", "text", 2048)


def nearest_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return control.nearest_ancestor(turns, "conv_id", "turn", F.when(F.col("role") == "user", F.col("text")))


def manifest_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests made from parts: how many rules each breaks."""
    part = _table(spark, sf_dir, "part", "p_partkey", "p_size")
    trust = F.when(F.col("p_size") > 25, "trusted").when(F.col("p_size") > 10, "untrusted").otherwise("other")
    runtime = F.when(F.col("p_partkey") % 2 == 0, "native").otherwise("wasm")
    problems = control.manifest_problems(trust, runtime, F.col("p_size") % 5 == 0)
    return part.select("p_partkey", F.size(problems).cast("bigint").alias("problems"))


def queue_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages for each queue."""
    part = _table(spark, sf_dir, "part", "p_partkey", "p_size")
    pool = control.route_pool(F.col("p_size") > 40, F.lit("untrusted"))
    return part.groupBy(control.queue_key(pool, F.concat(F.lit("class"), (F.col("p_size") % 3).cast("string"))).alias("queue")).agg(F.count("*").alias("n"))


def input_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part", "p_partkey", "p_size", "p_name", "p_brand", "p_type")
    some = lambda c, k: F.when(F.col("p_size") % k == 0, F.col(c))
    return part.select("p_partkey", control.resolve_input(some("p_name", 2), some("p_brand", 3), some("p_type", 5), F.lit("walked")).alias("value"))


def upsert_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the status of those a change names, and the changed ones that are new."""
    orders = _table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus")
    changes = orders.where("o_orderkey % 3 = 0").select(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).otherwise(-F.col("o_orderkey")).alias("o_orderkey"), F.lit("X").alias("o_orderstatus"))
    return control.upsert(orders, changes, ["o_orderkey"])


def context_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, and suppliers under keys that no customer has."""
    customers = _table(spark, sf_dir, "customer", "c_custkey", "c_name").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    suppliers = _table(spark, sf_dir, "supplier", "s_suppkey", "s_name").select((F.col("s_suppkey") * 40).alias("id"), F.col("s_name").alias("name"))
    return control.insert_if_absent(customers, suppliers, ["id"])


QUERIES: dict[str, Query] = {
    "single_chain": _rows(W.single_chain, "orders", "o_orderkey", "o_custkey"),
    "multi_output": multi_output,
    "if_else_value": _rows(W.if_else_value, "orders", "o_orderkey", "o_custkey"),
    "else_if": _rows(W.else_if_value, "orders", "o_orderkey", "o_custkey"),
    "branch_counts": branch_counts,
    "while_fib": while_fib,
    "while_rows": while_rows,
    "while_if_collatz": while_if_collatz,
    "stream_range": _rows(W.stream_range, "nation", "n_nationkey", "n_regionkey"),
    "stream_stream": _rows(W.stream_stream, "nation", "n_nationkey", "n_regionkey"),
    "leaf_failure_results": leaf_failure_results,
    "leaf_failure_errors": leaf_failure_errors,
    "batch_x2": _rows(W.batch_x2, "embeddings", "vec_id", "label"),
    "direct_x2": _rows(W.direct_x2, "embeddings", "vec_id", "label"),
    "etl_on_orders": _rows(W.etl_on_rows, "orders", "o_orderkey", "o_custkey"),
    "etl_even_arm": _rows(W.etl_even_arm, "orders", "o_orderkey", "o_custkey"),
    "media_on_nation": media_on_nation,
    "untaken_arm": _rows(W.untaken_arm, "orders", "o_orderkey", "o_custkey"),
    "filter_by_fan_out": _rows(W.filter_by_fan_out, "orders", "o_orderkey", "o_custkey"),
    "theta_join": _rows(W.theta_join, "nation", "n_nationkey", "n_regionkey"),
    "early_return": _rows(W.early_return, "orders", "o_orderkey", "o_custkey"),
    "nested_loops": _rows(W.nested_loops, "nation", "n_nationkey", "n_nationkey"),
    "python_loop": _rows(W.python_loop, "part", "p_partkey", "p_size"),
    "concatenated": _rows(W.concatenated, "nation", "n_nationkey", "n_regionkey"),
    "structured": structured,
    "unit_result": unit_result,
    "ordered_contexts": ordered_contexts,
    "run_progress": run_progress,
    "run_status": run_status,
    "upsert_last": upsert_last,
    "insert_first": insert_first,
    "expired_leases": expired_leases,
    "has_worker_json": has_worker_json,
    "newest_events": newest_events,
    "distinct_tasks": distinct_tasks,
    "missing_version": missing_version,
    "pool_route": pool_route,
    "input_hash": input_hash,
    "inline_group": inline_group,
    "nearest_ancestor": nearest_ancestor,
    "manifest_rules": manifest_rules,
    "queue_keys": queue_keys,
    "input_resolution": input_resolution,
    "upsert_join": upsert_join,
    "context_insert": context_insert,
}

ORACLE_SQL: dict[str, str] = {
    "single_chain": "select o_orderkey, cast((o_custkey + 1) * 2 as integer) as result from orders",
    "multi_output": "select o_orderkey, o_custkey as x, o_custkey > 750 as y, cast(o_custkey as varchar) as z from orders",
    "if_else_value": "select o_orderkey, cast(case when o_custkey > 700 then o_custkey * 2 else o_custkey end as integer) as result from orders",
    "else_if": "select o_orderkey, cast(case when o_custkey > 1000 then o_custkey * 2 when o_custkey < 300 then o_custkey * 2 else o_custkey end as integer) as result from orders",
    "branch_counts": "select case when o_orderkey % 2 = 0 then 'then' else 'else' end as arm, count(*) as n from orders group by 1",
    "while_fib": "with recursive w(a, b) as (select 0, 1 union all select b, a + b from w where a < 10) select b as result from w where a >= 10",
    "while_rows": "with recursive w(id, i) as (select p_partkey, p_size - p_size from part union all select id, case when i % 2 = 0 then i + 2 else i + 1 end from w where i < 10) select id, i as result from w where i >= 10",
    "while_if_collatz": "with recursive w(id, n, k) as (select s_suppkey, s_suppkey, 0::bigint from supplier where s_suppkey > 0 union all select id, case when n % 2 = 0 then n // 2 else n * 3 + 1 end, k + 1 from w where n <> 1) select id, k as result from w where n = 1",
    "stream_range": "select n_nationkey, cast(unnest(range(0, n_regionkey)) as integer) as result from nation",
    "stream_stream": "select n_nationkey, cast(a.i * 10 + b.x as integer) as result from nation, lateral (select unnest(range(0, n_regionkey)) i) a, range(0, 3) b(x)",
    "leaf_failure_results": "select l_orderkey, l_linenumber, l_suppkey as result from lineitem where l_linenumber <> 4",
    "leaf_failure_errors": "select 'intentional failure' as message, count(*) as n from lineitem where l_linenumber = 4",
    "batch_x2": "select vec_id, label * 2 as result from embeddings",
    "direct_x2": "select vec_id, label * 2 as result from embeddings",
    "etl_on_orders": "select o_orderkey, cast(case when ((o_custkey * 10) + 7) % 2 = 0 then (o_custkey * 10) + 7 + 3 else (o_custkey * 10) + 7 end as integer) as result from orders",
    "etl_even_arm": "select o_orderkey, cast(case when (o_custkey + 7) % 2 = 0 then o_custkey + 7 + 3 else o_custkey + 7 end as integer) as result from orders",
    "media_on_nation": "select n_nationkey + 7 as result from nation where n_nationkey <> 4",
    "untaken_arm": "select o_orderkey, cast(o_custkey as integer) as result from orders",
    "filter_by_fan_out": "select o_orderkey, cast(o_custkey as integer) as result from orders where o_custkey % 2 = 0",
    "theta_join": "select n_nationkey, cast(b.x as integer) as result from nation join range(0, 5) b(x) on b.x < n_regionkey",
    "early_return": "select o_orderkey, cast(case when o_custkey % 2 = 0 then o_custkey * 2 else o_custkey + 1 end as integer) as result from orders",
    "nested_loops": "select n_nationkey, cast((select coalesce(sum(i * (i - 1) // 2), 0) from range(0, n_nationkey) t(i)) as integer) as result from nation",
    "python_loop": "with recursive w(id, n, i) as (select p_partkey, p_size, 0 from part union all select id, n, i * 2 + 1 from w where i < n) select id as p_partkey, i as result from w where i >= n",
    "concatenated": "select n_nationkey, n_regionkey || '-suffix' as result from nation",
    "structured": "select n_nationkey, cast(n_regionkey as varchar) as value from nation",
    "unit_result": "select n_nationkey, true as unit from nation",
    "ordered_contexts": "select n_nationkey, row_number() over (partition by n_nationkey order by a.i, b.k) as place, cast(a.i + b.k as integer) as result, a.i as parent from nation, lateral (select unnest(range(0, n_regionkey)) i) a, range(0, 2) b(k)",
    "run_progress": "select user_id as run, count(*) filter (where event_type = 'purchase') as done, count(*) as total from events group by user_id",
    "run_status": "select user_id as run, case when count(*) filter (where event_type = 'error') > 0 then 'partial_failed' else 'succeeded' end as status from events group by 1",
    "upsert_last": "select user_id, event_type, arg_max(value, row(ts, event_id)) as value from events group by 1, 2",
    "insert_first": "select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) rn from events) q where rn = 1",
    "expired_leases": "select event_id from events where event_type = 'click' and ts is not null and ts < timestamp '2024-01-15 00:00:00'",
    "has_worker_json": "select event_id from events where event_type = 'view' and json_extract_string(props, '$.k') = '29'",
    "newest_events": "select event_id, ts from events order by ts desc, event_id desc limit 100",
    "distinct_tasks": "select distinct event_type from events",
    "missing_version": "select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)",
    "pool_route": "select p_partkey, case when p_size > 40 then 'gpu' when p_size > 25 then 'trusted' when p_size > 10 then 'restricted' else 'wasm' end as pool from part",
    "input_hash": "select doc_id, 'sha256:' || sha256(text) as h from documents",
    "inline_group": "select source, bool_and(strlen(text) <= 2048) as inl from documents group by source",
    "nearest_ancestor": "select conv_id, turn, last_value(case when role = 'user' then text end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and current row) as v from conversations",
    "manifest_rules": "with m as (select p_partkey, p_size <= 10 as other, p_size > 10 and p_size <= 25 as un, p_partkey % 2 <> 0 as wasm, p_size % 5 = 0 as gpu from part) select p_partkey, cast(other::int + (un and not wasm)::int + (wasm and not un)::int + (gpu and wasm)::int + (gpu and un)::int as bigint) as problems from m",
    "queue_keys": "select 'queue:' || case when p_size > 40 then 'gpu' else 'wasm' end || ':class' || (p_size % 3) as queue, count(*) as n from part group by 1",
    "input_resolution": "select p_partkey, coalesce(case when p_size % 2 = 0 then p_name end, case when p_size % 3 = 0 then p_brand end, case when p_size % 5 = 0 then p_type end, 'walked') as value from part",
    "upsert_join": "with c as (select case when o_orderkey % 2 = 0 then o_orderkey else -o_orderkey end as k from orders where o_orderkey % 3 = 0) select o_orderkey, case when k is null then o_orderstatus else 'X' end as o_orderstatus from orders left join c on k = o_orderkey union all select k, 'X' from c where k not in (select o_orderkey from orders)",
    "context_insert": "select c_custkey as id, c_name as name from customer union all select s_suppkey * 40, s_name from supplier where s_suppkey * 40 not in (select c_custkey from customer)",
}
