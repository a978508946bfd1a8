"""Tasks, the operators of a workflow, and their registry.

A task has a kind: single maps a row to one, batch maps rows in chunks, stream maps a row to any number, direct consumes
a partition's rows in a loop of its own. It may have a Column form (expr), which Catalyst compiles; else its Python
function runs in Arrow batches. Tasks must be deterministic: Spark may run them again.
"""

from __future__ import annotations

import asyncio
import dataclasses
import inspect
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("single", "batch", "stream", "direct")
#: Rows in a chunk of a batch task that names no size.
DEFAULT_BATCH = 16
#: Outputs that a task may have at most.
MOST_OUTPUTS = 9
DEFAULT_VERSION = "0.1"


class TaskError(Exception):
    """Raised by a task for one row; other rows go on."""


class UnknownTask(KeyError):
    pass


@dataclass(frozen=True)
class Task:
    id: str
    kind: str
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    #: Single: a value or a tuple of outputs. Batch: lists in, a list out. Stream: an iterable. Direct: a class.
    #: Single, batch and stream functions may be asynchronous; rows of an Arrow batch then wait together.
    fn: Callable | type | None = None
    #: The Column form; a stream's gives an array.
    expr: Callable[..., Column | Sequence[Column]] | None = None
    #: Whether the Column form fails on a row, and with which message.
    fails_when: Callable[..., Column] | None = None
    message: str = "task failed"
    batch_size: int = DEFAULT_BATCH
    version: str = DEFAULT_VERSION
    author: str = ""
    #: Called once in each Python worker before the first row.
    prepare: Callable[[], None] | None = None

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind of task: {self.kind}")
        if len(self.outputs) > MOST_OUTPUTS:
            raise ValueError(f"a task has at most {MOST_OUTPUTS} outputs")
        if self.kind != "single" and len(self.outputs) != 1:
            raise ValueError(f"a {self.kind} task has one output")
        if self.fn is None and self.expr is None:
            raise ValueError("a task needs a function or a Column form")

    @property
    def pure(self) -> bool:
        """Whether it is a Column form from one row to one."""
        return self.expr is not None and self.kind in ("single", "batch")

    def __call__(self, *args):
        """Outside of a workflow, a task is its function."""
        if self.kind == "direct":
            return [out for _, out in self.fn().run(iter([(0, args[0] if len(args) == 1 else args)]))]
        if self.kind == "batch":
            return call_plainly(self, [[args[0] if len(args) == 1 else args]])[0]
        return call_plainly(self, args)

    def columns(self, *args: Column) -> list[Column]:
        made = self.expr(*args)
        made = list(made) if isinstance(made, (tuple, list)) else [made]
        if len(made) != max(1, len(self.outputs)):
            raise ValueError(f"task {self.id} gives {len(made)} columns for {len(self.outputs)} outputs")
        return made


class Registry:
    """Tasks and types by name; a later one of the same name replaces the earlier."""

    def __init__(self) -> None:
        self.tasks: dict[str, Task] = {}
        self.types: dict[str, T.StructType] = {}

    def add(self, task: Task) -> Task:
        self.tasks[task.id] = task
        return task

    def get(self, name: str) -> Task:
        if name not in self.tasks:
            raise UnknownTask(name)
        return self.tasks[name]

    def add_type(self, cls: type) -> type:
        self.types[cls.__name__] = struct_of(cls)
        return cls

    def register_sql(self, spark: SparkSession) -> None:
        """Make the single tasks that have a function callable in SQL by their names."""
        for t in self.tasks.values():
            if t.kind == "single" and t.fn and len(t.outputs) == 1 and t.outputs != ("void",):
                spark.udf.register(t.id, t.fn, T._parse_datatype_string(t.outputs[0]))


registry = Registry()


def task(kind: str = "single", *, inputs: Sequence[str] | str, output: Sequence[str] | str = "void", name: str | None = None, into: Registry | None = None, **more: Any):
    """Declare a function, or for a direct task a class, as a task; it registers itself under its name."""

    def declare(fn):
        ins = tuple(x.strip() for x in inputs.split(",")) if isinstance(inputs, str) and inputs else tuple(inputs)
        outs = (output,) if isinstance(output, str) else tuple(output)
        return (registry if into is None else into).add(Task(name or fn.__name__, kind, ins, outs, fn, **more))

    return declare


#: DDL types of Python annotations.
_ANNOTATIONS = {bool: T.BooleanType(), int: T.IntegerType(), float: T.DoubleType(), str: T.StringType(), bytes: T.BinaryType()}


def struct_of(cls: type) -> T.StructType:
    """The struct of a dataclass's fields; fields may be dataclasses and lists too."""

    def kind(a) -> T.DataType:
        if dataclasses.is_dataclass(a):
            return struct_of(a)
        if getattr(a, "__origin__", None) is list:
            return T.ArrayType(kind(a.__args__[0]))
        return _ANNOTATIONS[a]

    hints = inspect.get_annotations(cls, eval_str=True)
    return T.StructType([T.StructField(f.name, kind(hints[f.name])) for f in dataclasses.fields(cls)])


def user_type(cls: type) -> type:
    """Declare a dataclass as a type that tasks may take and give."""
    cls = cls if dataclasses.is_dataclass(cls) else dataclass(cls)
    return registry.add_type(cls)


def chunks(rows: Iterable, size: int) -> Iterator[list]:
    """Rows in lists of the size; the last may be shorter."""
    mine: list = []
    for r in rows:
        mine.append(r)
        if len(mine) == size:
            yield mine
            mine = []
    if mine:
        yield mine


def is_async(task: Task) -> bool:
    return inspect.iscoroutinefunction(task.fn) or inspect.isasyncgenfunction(task.fn)


async def _gathered(fn: Callable, args: Sequence) -> Any:
    if inspect.isasyncgenfunction(fn):
        return [x async for x in fn(*args)]
    return await fn(*args)


def call_plainly(task: Task, args: Sequence) -> Any:
    """A task's result for some arguments, waited for where its function is asynchronous."""
    return asyncio.run(_gathered(task.fn, args)) if is_async(task) else task.fn(*args)


def call_together(task: Task, rows: Sequence[Sequence]) -> list:
    """An asynchronous task's results for many rows, waited for together; an exception stands for its row's result."""

    async def everything() -> list:
        return await asyncio.gather(*(_gathered(task.fn, r) for r in rows), return_exceptions=True)

    return asyncio.run(everything())


def packed(values: Sequence):
    """Inputs as a task's one argument: none is unit, one is itself, more are a tuple."""
    return None if not values else values[0] if len(values) == 1 else tuple(values)


def unpacked(value, arity: int) -> list:
    """A result as outputs; a tuple of another length is an error."""
    if arity == 1:
        return [value]
    if arity == 0:
        return []
    if not isinstance(value, (tuple, list)) or len(value) != arity:
        raise TaskError(f"expected {arity} values, got {value!r}")
    return list(value)


def half_open(start: Column, end: Column) -> Column:
    """The integers from start up to, but without, end; empty unless start is below end."""
    return F.when(start < end, F.sequence(start, end - 1)).otherwise(F.array().cast("array<int>"))
