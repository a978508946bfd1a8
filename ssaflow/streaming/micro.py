"""Workflows over streams: each micro-batch runs through the same lowering as a batch, exactly once per batch number."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ssaflow.engine import Engine
from ssaflow.plans import ir
from ssaflow.plans.trace import TracedWorkflow


def run_stream(engine: Engine, workflow: ir.Workflow | TracedWorkflow, stream: DataFrame, results: str, checkpoint: str, errors: str | None = None, keep: Sequence[str] = (), params: dict[str, str] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Start a query that runs a workflow over each micro-batch and writes results, and errors if asked for, as Parquet.

    Output goes to a folder for each batch, which a repeated batch overwrites: results are exact after a failure.
    """
    name = engine.create_workflow(workflow)

    def each(batch: DataFrame, number: int) -> None:
        done = engine.run(name, batch, keep, params)
        done.results.write.mode("overwrite").parquet(f"{results}/batch={number}")
        if errors:
            done.errors.write.mode("overwrite").parquet(f"{errors}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class WorkQueue:
    """A durable queue of messages in folders by queue key; readers keep their place in a checkpoint."""

    SCHEMA = "run_id string, op_id int, ctx_id int, task_id string, task_version string, input_ids array<int>, lease_ms bigint, input_values string"

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def push(self, messages: DataFrame, queue: str) -> None:
        messages.withColumn("queue", F.lit(queue)).write.mode("append").partitionBy("queue").parquet(self.folder)

    def read(self, queue: str, files_per_batch: int = 1) -> DataFrame:
        reader = self.spark.readStream.schema(f"{self.SCHEMA}, queue string").option("maxFilesPerTrigger", files_per_batch)
        return reader.parquet(self.folder).where(F.col("queue") == queue)

    def consume(self, queue: str, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
        """Give each batch of messages to handle; what a finished batch held isn't given again."""
        return self.read(queue).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_state(stream: DataFrame, key: str, value: str, fold: Callable[[float, float], float], start: float) -> DataFrame:
    """A keyed operator with state across inputs: for each row of a key its fold so far, in order of arrival."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(keys, frames, state: GroupState):
        total = state.get[0] if state.exists else start
        for pdf in frames:
            out = []
            for v in pdf[value]:
                total = fold(total, float(v))
                out.append(total)
            yield pd.DataFrame({key: [keys[0]] * len(out), "state": out})
        state.update((total,))

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, state double", "total double", "append", GroupStateTimeout.NoTimeout)
