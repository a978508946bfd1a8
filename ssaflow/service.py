"""The orchestrator's interface as methods: tasks, workflows, runs, nodes, workers and events over metadata frames.

Metadata is small and lives in frames that each change replaces; a folder, where given, keeps them as Parquet.
"""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ssaflow.engine import Engine, RunResult
from ssaflow.operators import control
from ssaflow.operators.tasks import Registry, registry
from ssaflow.plans import ir
from ssaflow.sources.bundles import Bundle, Manifest


class Orchestrator:
    def __init__(self, spark: SparkSession, tasks: Registry = registry, folder: str | None = None) -> None:
        self.spark, self.engine, self.folder = spark, Engine(spark, tasks), folder
        self.rows: dict[str, list[dict]] = {n: [] for n in control.TABLES}
        self.results: dict[str, RunResult] = {}

    def table(self, name: str) -> DataFrame:
        """A metadata table as a frame."""
        return self.spark.createDataFrame([tuple(r.get(c) for c in self._columns(name)) for r in self.rows[name]], control.TABLES[name])

    @staticmethod
    def _columns(name: str) -> list[str]:
        return [x.split()[0] for x in control.TABLES[name].replace("map<string,string>", "map").split(", ")]

    def _put(self, name: str, **row) -> None:
        key = lambda r: tuple(r.get(k) for k in control.KEYS[name])
        old = next((r for r in self.rows[name] if key(r) == key(row)), None)
        if old:
            old.update(row)
        else:
            self.rows[name].append(row)

    def _now(self) -> datetime:
        return datetime.now(timezone.utc)

    def _event(self, run_id: str, **event) -> None:
        self.rows["events"].append({"run_id": run_id, "seq": len(self.rows["events"]), "event": json.dumps(event), "created_at": self._now()})

    def save(self) -> None:
        """Write all tables below the folder."""
        for name in control.TABLES:
            self.table(name).write.mode("overwrite").parquet(f"{self.folder}/{name}")

    def health(self) -> str:
        return "ok"

    def upload_task(self, manifest: Manifest, artifact: bytes = b"", uri: str = "") -> None:
        """A manifest, and its artifact, whose checksum must be the manifest's where that has one."""
        if artifact and manifest.checksum and hashlib.sha256(artifact).hexdigest() != manifest.checksum:
            raise ValueError("the artifact doesn't have the manifest's checksum")
        if problems := manifest.problems():
            raise ValueError("; ".join(problems))
        self._put("tasks", id=manifest.task_id, version=manifest.version, manifest_json=manifest.to_json(), checksum=manifest.checksum, created_at=self._now())
        self._put("task_artifacts", id=f"{manifest.task_id}@{manifest.version}", task_id=manifest.task_id, task_version=manifest.version, uri=uri, size_bytes=len(artifact), created_at=self._now())

    def get_manifest(self, task_id: str, version: str) -> dict:
        return control.get_task_manifest(self.table("tasks"), task_id, version)

    def upload_workflow(self, made: Bundle) -> None:
        self._put("workflows", id=made.id, version=made.version, ir_json=ir.dumps(made.ir), task_versions=made.task_versions, created_at=self._now())

    def register_worker(self, worker_id: str, pool: str, resource_class: str, labels: dict | None = None) -> None:
        labels = (labels or {}) | {"pool": control.normal_pool(pool), "resource_class": resource_class}
        self._put("workers", id=worker_id, labels_json=json.dumps(labels), status="ok", last_heartbeat=self._now())

    def workers(self) -> list[dict]:
        return [json.loads(r.worker) for r in control.list_workers(self.table("workers")).collect()]

    def create_run(self, workflow_id: str, version: str, root: DataFrame | None = None, keep=(), params=None) -> str:
        """Run a workflow; the run's record, contexts of the root and node counts follow its frames."""
        wf, versions = control.get_workflow(self.table("workflows"), workflow_id, version)
        missing = [t for t in wf.task_ids() if t not in versions]
        if missing:
            raise KeyError(f"no version of {', '.join(missing)}")
        run_id = self.engine.create_run(self.engine.create_workflow(wf))
        self._put("runs", id=run_id, workflow_id=workflow_id, workflow_version=version, status="running", created_at=self._now(), updated_at=self._now())
        self._put("contexts", id=0, run_id=run_id, parent_ctx_id=None, status="active", created_at=self._now())
        for op_id, op in enumerate(wf.operations):
            if op.call:
                self.start_node(run_id, op_id, 0)
                self._event(run_id, kind="queued", op_id=op_id, task_id=op.call.task_id)
        self.results[run_id] = self.engine.run(run_id, root, keep, params)
        failed = {r.op for r in self.results[run_id].errors.select("op").distinct().collect()}
        for op_id, op in enumerate(wf.operations):
            if op.call:
                self.complete_node(run_id, op_id, 0, None if op_id not in failed else "task failed")
        self._put("contexts", id=0, run_id=run_id, status="done")
        self._put("runs", id=run_id, status="partial_failed" if failed else "succeeded", updated_at=self._now())
        self._event(run_id, kind="finished", status=self.run_status(run_id))
        return run_id

    def start_node(self, run_id: str, op_id: int, ctx_id: int, lease_ms: int = control.LEASE_MS) -> None:
        until = datetime.fromtimestamp(self._now().timestamp() + lease_ms / 1000, timezone.utc)
        self._put("run_nodes", id=f"{run_id}/{op_id}/{ctx_id}", run_id=run_id, op_id=op_id, ctx_id=ctx_id, status="running", retries=0, last_error=None, lease_expires_at=until, updated_at=self._now())

    def complete_node(self, run_id: str, op_id: int, ctx_id: int, error: str | None) -> None:
        self._put("run_nodes", run_id=run_id, op_id=op_id, ctx_id=ctx_id, status="failed" if error else "succeeded", last_error=error, updated_at=self._now())
        self._event(run_id, kind="failed" if error else "succeeded", op_id=op_id, error=error)

    def expire_leases(self) -> int:
        late = control.expired_leases(self.table("run_nodes")).collect()
        for r in late:
            self.complete_node(r.run_id, r.op_id, r.ctx_id, "lease expired")
        return len(late)

    def run_status(self, run_id: str) -> str:
        return control.get_run_status(self.table("runs"), run_id)

    def run_progress(self, run_id: str) -> tuple[int, int]:
        row = control.run_progress(self.table("run_nodes").where(F.col("run_id") == run_id), "run_id", F.col("status").isin("succeeded", "failed")).first()
        return (row.done, row.total) if row else (0, 0)

    def values(self, run_id: str) -> DataFrame:
        """All results of a run, not only the root's."""
        return self.results[run_id].results

    def events(self, run_id: str, limit: int = control.EVENT_PAGE) -> list[dict]:
        mine = self.table("events").where(F.col("run_id") == run_id)
        return [json.loads(r.event) for r in control.read_events(mine, ["seq"], limit).collect()]
