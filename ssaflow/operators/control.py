"""The control plane as queries over metadata frames.

Tables hold one version of a row per key; changes are frames of new rows. Upserts keep the last row of a key by an order
column, inserts the first; both are partial aggregations, so a hot key costs no more than its group's one row a task.
Schemas follow the metadata tables: tasks, task_artifacts, workflows, runs, contexts, run_nodes, workers, events, queue.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The names of the metadata tables, their columns and keys, as DDL.
TABLES = {
    "tasks": "id string, version string, manifest_json string, checksum string, created_at timestamp",
    "task_artifacts": "id string, task_id string, task_version string, uri string, size_bytes bigint, created_at timestamp",
    "workflows": "id string, version string, ir_json string, task_versions map<string,string>, created_at timestamp",
    "runs": "id string, workflow_id string, workflow_version string, status string, created_at timestamp, updated_at timestamp",
    "contexts": "id int, run_id string, parent_ctx_id int, status string, created_at timestamp",
    "run_nodes": "id string, run_id string, op_id int, ctx_id int, status string, retries int, last_error string, lease_expires_at timestamp, updated_at timestamp",
    "workers": "id string, labels_json string, status string, last_heartbeat timestamp",
    "events": "run_id string, seq bigint, event string, created_at timestamp",
}
KEYS = {"tasks": ("id", "version"), "task_artifacts": ("id",), "workflows": ("id", "version"), "runs": ("id",), "contexts": ("run_id", "id"), "run_nodes": ("run_id", "op_id", "ctx_id"), "workers": ("id",)}

#: Defaults and vocabularies.
INLINE_LIMIT = 262_144
CACHE_BYTES = 268_435_456
LEASE_MS = 60_000
EVENT_PAGE = 100
POOLS = ("trusted", "restricted", "wasm", "gpu")
TRUST = ("trusted", "restricted", "untrusted")
RUNTIMES = ("native", "wasm")


def create_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """Empty metadata tables."""
    return {n: spark.createDataFrame([], ddl) for n, ddl in TABLES.items()}


def _latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], last: bool) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    best = rows.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *(F.col(f"_row.`{c}`").alias(c) for c in rest)).select(rows.columns)


def upsert_last(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The last row of each key."""
    return _latest(rows, keys, order, True)


def insert_first(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key."""
    return _latest(rows, keys, order, False)


def upsert(table: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """table with the rows of changes (one a key) in place of those with their keys; changes may name fewer columns,
    whose other values stay."""
    given = [c for c in table.columns if c in changes.columns and c not in keys]
    new = changes.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in given), F.lit(True).alias("_given"))
    both = table.withColumn("_old", F.lit(True)).join(new, list(keys), "full_outer")
    return both.select(*(F.col(c) if c in keys else F.when(F.col("_given"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in table.columns))


def insert_if_absent(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """table and those rows whose keys it lacks."""
    return table.unionByName(rows.join(table.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def update(table: DataFrame, where: Column, **values: Column) -> DataFrame:
    """table with new values in the rows that a condition picks."""
    return table.select(*(F.when(where, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns))


# ---- tasks, workflows, runs ------------------------------------------------------------------------------------------


def insert_task(tasks: DataFrame, manifests: DataFrame) -> DataFrame:
    """manifests: id, version, manifest_json, checksum, created_at."""
    return upsert(tasks, manifests, KEYS["tasks"])


def insert_task_artifact(artifacts: DataFrame, rows: DataFrame) -> DataFrame:
    """rows: task_id, task_version, uri, size_bytes, created_at; they get ids."""
    return artifacts.unionByName(rows.withColumn("id", F.expr("uuid()")).select(artifacts.columns))


def get_task_manifest(tasks: DataFrame, task_id: str, version: str) -> dict:
    row = tasks.where((F.col("id") == task_id) & (F.col("version") == version)).select("manifest_json").first()
    if row is None:
        raise KeyError((task_id, version))
    return json.loads(row.manifest_json)


def insert_workflow(workflows: DataFrame, rows: DataFrame) -> DataFrame:
    return upsert(workflows, rows, KEYS["workflows"])


def get_workflow(workflows: DataFrame, workflow_id: str, version: str):
    """The portable form and the tasks' versions."""
    from ssaflow.plans import ir

    row = workflows.where((F.col("id") == workflow_id) & (F.col("version") == version)).first()
    if row is None:
        raise KeyError((workflow_id, version))
    return ir.loads(row.ir_json), dict(row.task_versions)


def create_run(runs: DataFrame, workflow_id: str, version: str) -> tuple[DataFrame, str]:
    import uuid

    run_id = str(uuid.uuid4())
    row = runs.sparkSession.range(1).select(F.lit(run_id).alias("id"), F.lit(workflow_id).alias("workflow_id"), F.lit(version).alias("workflow_version"), F.lit("queued").alias("status"), F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at"))
    return runs.unionByName(row), run_id


def set_run_status(runs: DataFrame, run_id: str, status: str) -> DataFrame:
    return update(runs, F.col("id") == run_id, status=F.lit(status), updated_at=F.current_timestamp())


def upsert_run_node(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """rows: run_id, op_id, ctx_id, status, lease_expires_at and, for new nodes, id."""
    return upsert(nodes, rows, KEYS["run_nodes"])


def update_run_node(nodes: DataFrame, run_id: str, op_id: int, ctx_id: int, status: str, error: str | None = None) -> DataFrame:
    where = (F.col("run_id") == run_id) & (F.col("op_id") == op_id) & (F.col("ctx_id") == ctx_id)
    return update(nodes, where, status=F.lit(status), last_error=F.lit(error).cast("string"), updated_at=F.current_timestamp())


def create_context(contexts: DataFrame, rows: DataFrame) -> DataFrame:
    return insert_if_absent(contexts, rows, KEYS["contexts"])


def finish_context(contexts: DataFrame, run_id: str, ctx_id: int) -> DataFrame:
    return update(contexts, (F.col("run_id") == run_id) & (F.col("id") == ctx_id), status=F.lit("done"))


# ---- progress and status ---------------------------------------------------------------------------------------------


def run_progress(rows: DataFrame, run: str, done: Column) -> DataFrame:
    """Per run how many rows are done, and how many there are."""
    return rows.groupBy(F.col(run).alias("run")).agg(F.count_if(done).alias("done"), F.count("*").alias("total"))


def run_status(rows: DataFrame, run: str, failed: Column) -> DataFrame:
    """Per run, partial_failed if any row failed, else succeeded."""
    return rows.groupBy(F.col(run).alias("run")).agg(F.when(F.count_if(failed) > 0, "partial_failed").otherwise("succeeded").alias("status"))


def complete_status(contexts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per run of contexts: running while a context is active or nodes are missing, else by failures."""
    active = contexts.groupBy("run_id").agg(F.count_if(F.col("status") == "active").alias("active"))
    counts = nodes.groupBy("run_id").agg(F.count("*").alias("total"), F.count_if(F.col("status").isin("succeeded", "failed")).alias("done"), F.count_if(F.col("status") == "failed").alias("failed"))
    zero = {c: 0 for c in ("total", "done", "failed")}
    ended = (F.col("active") == 0) & (F.col("done") >= F.col("total"))
    return active.join(counts, "run_id", "left").fillna(zero).select("run_id", F.when(~ended, "running").when(F.col("failed") > 0, "partial_failed").otherwise("succeeded").alias("status"))


def count_by_status(table: DataFrame, run_id: str, status: str) -> int:
    return table.where((F.col("run_id") == run_id) & (F.col("status") == status)).count()


def get_run_status(runs: DataFrame, run_id: str) -> str:
    row = runs.where(F.col("id") == run_id).select("status").first()
    return row.status if row and row.status else "unknown"


def expired_leases(nodes: DataFrame, now: Column | None = None) -> DataFrame:
    """Nodes that run on after their lease."""
    now = F.current_timestamp() if now is None else now
    return nodes.where((F.col("status") == "running") & F.col("lease_expires_at").isNotNull() & (F.col("lease_expires_at") < now)).select("run_id", "op_id", "ctx_id")


def sweep_leases(nodes: DataFrame, now: Column | None = None) -> DataFrame:
    """Nodes with those whose lease is over marked failed."""
    now = F.current_timestamp() if now is None else now
    where = (F.col("status") == "running") & F.col("lease_expires_at").isNotNull() & (F.col("lease_expires_at") < now)
    return update(nodes, where, status=F.lit("failed"), last_error=F.lit("lease expired"))


# ---- workers and events ----------------------------------------------------------------------------------------------


def list_workers(workers: DataFrame) -> DataFrame:
    return workers.select(F.to_json(F.struct("id", "labels_json", "status", "last_heartbeat")).alias("worker"))


def has_worker(workers: DataFrame, pool: str, resource_class: str) -> bool:
    label = lambda k: F.get_json_object("labels_json", f"$.{k}")
    return not workers.where((F.col("status") == "ok") & (label("pool") == pool) & (label("resource_class") == resource_class)).limit(1).isEmpty()


def register_worker(workers: DataFrame, worker_id: str, labels: dict, pool: str, resource_class: str) -> DataFrame:
    name = normal_pool(pool)
    row = workers.sparkSession.range(1).select(F.lit(worker_id).alias("id"), F.lit(json.dumps(labels | {"pool": name, "resource_class": resource_class})).alias("labels_json"), F.lit("ok").alias("status"), F.current_timestamp().alias("last_heartbeat"))
    return upsert(workers, row, KEYS["workers"])


def read_events(events: DataFrame, order: Sequence[Column | str], limit: int = EVENT_PAGE) -> DataFrame:
    """The newest events first."""
    return events.orderBy(*(F.desc(c) if isinstance(c, str) else c.desc() for c in order)).limit(limit)


# ---- planning --------------------------------------------------------------------------------------------------------


def distinct_tasks(rows: DataFrame, task: str) -> DataFrame:
    return rows.select(task).dropDuplicates()


def missing_versions(needed: DataFrame, known: DataFrame, on: Column) -> DataFrame:
    """Rows that have no partner among the known ones."""
    return needed.join(known, on, "left_anti")


def route_pool(gpu: Column, trust: Column) -> Column:
    """gpu goes first; then trust decides, and what is untrusted goes to the sandbox."""
    return F.when(gpu, "gpu").when(trust == "trusted", "trusted").when(trust == "restricted", "restricted").otherwise("wasm")


def manifest_problems(trust: Column, runtime: Column, gpu: Column) -> Column:
    """What is wrong with a manifest, as an array of messages."""
    untrusted, wasm = trust == "untrusted", runtime == "wasm"
    rules = [
        ("no such trust", ~trust.isin(*TRUST)),
        ("no such runtime", ~runtime.isin(*RUNTIMES)),
        ("an untrusted task needs the wasm runtime", untrusted & ~wasm),
        ("the wasm runtime is for untrusted tasks", wasm & ~untrusted),
        ("a gpu task needs the native runtime", gpu & wasm),
        ("a gpu task can't be untrusted", gpu & untrusted),
    ]
    return F.filter(F.array(*(F.when(F.coalesce(broken, F.lit(True)), F.lit(text)) for text, broken in rules)), lambda x: x.isNotNull())


def normal_pool(name: str) -> str:
    found = name.strip().lower()
    if found not in POOLS:
        raise ValueError(f"unknown pool: {name}")
    return found


def valid_pool(name: Column) -> Column:
    return F.lower(F.trim(name)).isin(*POOLS)


def queue_key(pool: Column, resource_class: Column) -> Column:
    return F.concat_ws(":", F.lit("queue"), pool, resource_class)


def input_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def object_key(text: Column) -> Column:
    """Where a large value lies in an object store."""
    return F.concat(F.lit("values/"), input_hash(text), F.lit(".json"))


def fits_inline(text: Column, limit: int = INLINE_LIMIT) -> Column:
    return F.octet_length(text) <= limit if limit > 0 else F.lit(False)


def inline_groups(rows: DataFrame, call: str, text: str, limit: int = INLINE_LIMIT) -> DataFrame:
    """A call's inputs go inline only if all of them fit."""
    return rows.groupBy(call).agg(F.bool_and(fits_inline(F.col(text), limit)).alias("inl"))


def resolve_input(cached: Column, inline: Column, stored: Column, walked: Column) -> Column:
    """The first source that has the value."""
    return F.coalesce(cached, inline, stored, walked)


def nearest_ancestor(rows: DataFrame, chain: str, depth: str, value: Column, name: str = "v") -> DataFrame:
    """In linear chains, each row's own value or else its nearest ancestor's."""
    from pyspark.sql import Window

    upward = Window.partitionBy(chain).orderBy(depth).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select(chain, depth, F.last(value, ignorenulls=True).over(upward).alias(name))


def ancestor_values(spark: SparkSession, contexts: str, values: str, value_id: int, max_hops: int = 10_000) -> DataFrame:
    """In trees, each context's own value or else its nearest ancestor's. contexts and values name views with the
    columns (run_id, id, parent_ctx_id) and (run_id, ctx_id, value_id, value)."""
    return spark.sql(f"""
        WITH RECURSIVE up(run_id, id, here, hops) MAX RECURSION LEVEL {max_hops} AS (
          SELECT run_id, id, id, 0 FROM {contexts}
          UNION ALL
          SELECT u.run_id, u.id, c.parent_ctx_id, u.hops + 1 FROM up u JOIN {contexts} c ON c.run_id = u.run_id AND c.id = u.here
          WHERE c.parent_ctx_id IS NOT NULL
            AND NOT EXISTS (SELECT 1 FROM {values} o WHERE o.run_id = u.run_id AND o.ctx_id = u.here AND o.value_id = {int(value_id)}))
        SELECT u.run_id, u.id AS ctx_id, min_by(v.value, u.hops) AS value
        FROM up u JOIN {values} v ON v.run_id = u.run_id AND v.ctx_id = u.here AND v.value_id = {int(value_id)}
        GROUP BY u.run_id, u.id""")
