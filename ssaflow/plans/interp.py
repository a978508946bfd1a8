"""A row-at-a-time interpreter of the portable form: the oracle of tests, and the way loops over literals are folded."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from ssaflow.operators.tasks import Registry, call_plainly, packed, unpacked
from ssaflow.plans import ir


class LoopLimit(RuntimeError):
    """A context took more steps than allowed."""


@dataclass
class Outcome:
    #: (context path, value) of each return, and (context path, operation, message) of each failure.
    results: list[tuple[tuple[int, ...], object]] = field(default_factory=list)
    errors: list[tuple[tuple[int, ...], int, str]] = field(default_factory=list)

    def values(self) -> list:
        return [v for _, v in sorted(self.results, key=lambda r: r[0])]


def step(op: ir.Operation, values: dict, before: int | None) -> dict:
    """Values after literals and phis; all phis read what was before them."""
    known = dict(values)
    for x in op.literals:
        known[x.output] = ir.parse_literal(x.value, x.type)[0]
    if before is not None:
        known |= {p.output: known[dict(p.sources)[before]] for p in op.phis}
    return known


def following(op: ir.Operation, values: dict) -> int | None:
    if isinstance(op.next, ir.Jump):
        return op.next.next
    if isinstance(op.next, ir.Branch):
        flag = values[op.next.var]
        if not isinstance(flag, bool):
            raise TypeError("a branch needs a boolean")
        return op.next.true_next if flag else op.next.false_next
    return None


def _outputs(task, args: list) -> Iterator:
    """Results of a call, one for each context that goes on."""
    if task.kind == "stream":
        yield from call_plainly(task, args)
    elif task.kind == "batch":
        yield call_plainly(task, [[packed(args)]])[0]
    elif task.kind == "direct":
        yield from (v for _, v in task.fn().run(iter([(0, packed(args))])))
    else:
        yield call_plainly(task, args)


def run(wf: ir.Workflow, registry: Registry, params: dict | None = None, most_steps: int = 1_000_000) -> Outcome:
    out = Outcome()
    start = {v: (params or {})[n] for n, v in wf.params}
    stack: list[tuple[int, int | None, tuple[int, ...], dict]] = [(0, None, (), start)]
    steps = 0
    while stack:
        at, before, path, values = stack.pop()
        steps += 1
        if steps > most_steps:
            raise LoopLimit(f"more than {most_steps} steps in {wf.name}")
        op = wf.operations[at]
        values = step(op, values, before)
        branches = [(path, values)]
        if op.call:
            task, branches = registry.get(op.call.task_id), []
            try:
                for k, result in enumerate(_outputs(task, [values[v] for v in op.call.inputs])):
                    more = dict(zip(op.call.outputs, unpacked(result, len(op.call.outputs)), strict=True))
                    branches.append(((*path, k) if task.kind == "stream" else path, values | more))
            except Exception as e:  # noqa: BLE001  whatever a task raises fails its row
                out.errors.append((path, at, str(e)))
        for p, v in branches:
            if isinstance(op.next, ir.Return):
                out.results.append((p, None if op.next.var is None else v[op.next.var]))
                continue
            try:
                stack.append((following(op, v), at, p, v))
            except TypeError as e:
                out.errors.append((p, at, str(e)))
    return out
