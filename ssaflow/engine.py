"""Running workflows: create, run, and read results, errors and status."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ssaflow.operators.tasks import Registry, Task, registry
from ssaflow.plans import ir
from ssaflow.plans.lower import Lowering
from ssaflow.plans.trace import TracedWorkflow


@dataclass(frozen=True)
class RunResult:
    """Lazy frames: one row for each context that returned, and one for each that failed."""

    run_id: str
    results: DataFrame
    errors: DataFrame

    def status(self) -> str:
        return "succeeded" if self.errors.isEmpty() else "partial_failed"

    def values(self) -> list:
        """All results, in the order of contexts where they fan out; for small runs."""
        rows = self.results.orderBy("ctx_path") if "ctx_path" in self.results.columns else self.results
        return [r.result for r in rows.collect()]


class Engine:
    """Keeps workflows and runs by id. Tasks come from the registry, or from the one given."""

    def __init__(self, spark: SparkSession, tasks: Registry = registry) -> None:
        self.spark, self.tasks = spark, tasks
        self.workflows: dict[str, ir.Workflow] = {}
        self.runs: dict[str, str] = {}
        self.finished: dict[str, RunResult] = {}

    def add_task(self, task: Task) -> None:
        self.tasks.add(task)

    def create_workflow(self, workflow: ir.Workflow | TracedWorkflow) -> str:
        made = workflow.ir if isinstance(workflow, TracedWorkflow) else workflow
        self.workflows[made.name] = made
        return made.name

    def create_run(self, workflow_id: str) -> str:
        run_id = str(uuid.uuid4())
        if workflow_id not in self.workflows:
            raise KeyError(workflow_id)
        self.runs[run_id] = workflow_id
        return run_id

    def run(self, workflow: str | ir.Workflow | TracedWorkflow, root: DataFrame | None = None, keep: Sequence[str] = (), params: dict[str, str] | None = None) -> RunResult:
        """Run a workflow, or a run by its id. Each row of root is a context; keep names the columns that results carry,
        params the column for each parameter, a column of its name unless given."""
        if isinstance(workflow, str):
            run_id = workflow if workflow in self.runs else self.create_run(workflow)
            wf = self.workflows[self.runs[run_id]]
        else:
            run_id = self.create_run(self.create_workflow(workflow))
            wf = self.workflows[self.runs[run_id]]
        root = self.spark.range(1).select() if root is None else root
        columns = {n: (params or {}).get(n, n) for n, _ in wf.params}
        missing = [c for c in [*columns.values(), *keep] if c not in root.columns]
        if missing:
            raise ir.InvalidWorkflow(f"the root frame lacks {', '.join(missing)}")
        results, errors = Lowering(wf, self.tasks, root, list(keep), columns).run()
        self.finished[run_id] = RunResult(run_id, results, errors)
        return self.finished[run_id]

    def get_result(self, run_id: str) -> DataFrame:
        return self.finished[run_id].results


def run(spark: SparkSession, workflow: ir.Workflow | TracedWorkflow, root: DataFrame | None = None, keep: Sequence[str] = (), params: dict[str, str] | None = None) -> RunResult:
    """Run a workflow once."""
    return Engine(spark).run(workflow, root, keep, params)
