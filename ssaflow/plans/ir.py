"""The portable form of a workflow: a list of operations, each with literals, phis, at most one call and a successor."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Literal:
    output: int
    value: str
    #: DDL type where the text alone doesn't tell it.
    type: str | None = None


@dataclass(frozen=True)
class Phi:
    output: int
    #: (operation that control comes from, value then).
    sources: tuple[tuple[int, int], ...]


@dataclass(frozen=True)
class Call:
    task_id: str
    inputs: tuple[int, ...]
    outputs: tuple[int, ...]


@dataclass(frozen=True)
class Jump:
    next: int


@dataclass(frozen=True)
class Branch:
    var: int
    true_next: int
    false_next: int


@dataclass(frozen=True)
class Return:
    var: int | None


Next = Jump | Branch | Return


@dataclass(frozen=True)
class Operation:
    literals: tuple[Literal, ...] = ()
    phis: tuple[Phi, ...] = ()
    call: Call | None = None
    next: Next = Return(None)

    def successors(self) -> tuple[int, ...]:
        if isinstance(self.next, Jump):
            return (self.next.next,)
        return (self.next.true_next, self.next.false_next) if isinstance(self.next, Branch) else ()


@dataclass(frozen=True)
class Workflow:
    """Operation 0 is the entry. params name the values that a root frame's columns give."""

    name: str
    operations: tuple[Operation, ...]
    params: tuple[tuple[str, int], ...] = field(default=())

    def task_ids(self) -> list[str]:
        return sorted({op.call.task_id for op in self.operations if op.call})


class InvalidWorkflow(ValueError):
    """The workflow's graph or types don't hold together."""


def literal_text(value) -> tuple[str, str | None]:
    """A literal's text, and its type where the text doesn't tell it."""
    if value is None:
        return "()", None
    if isinstance(value, bool):
        return ("true" if value else "false"), None
    if isinstance(value, int):
        return str(value), None if -(1 << 31) <= value < 1 << 31 else "bigint"
    if isinstance(value, float):
        return repr(value), "double"
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False), "string"
    raise InvalidWorkflow(f"no literal of type {type(value).__name__}")


def parse_literal(text: str, kind: str | None = None):
    """The value and DDL type of a literal: true, false, (), a 32-bit integer, or else a string without its quotes."""
    if kind == "string":
        return json.loads(text), "string"
    if kind == "double":
        return float(text), "double"
    if kind == "bigint":
        return int(text), "bigint"
    if text in ("true", "false"):
        return text == "true", "boolean"
    if text == "()":
        return None, "void"
    try:
        number = int(text)
    except ValueError:
        return text.strip('"'), "string"
    if text.strip() == text and -(1 << 31) <= number < 1 << 31 and "_" not in text:
        return number, "int"
    return text.strip('"'), "string"


def _next_to(n: Next) -> dict:
    if isinstance(n, Jump):
        return {"Jump": {"next": n.next}}
    if isinstance(n, Branch):
        return {"Branch": {"var": n.var, "true_next": n.true_next, "false_next": n.false_next}}
    return {"Return": {"var": n.var}}


def _next_from(d: dict) -> Next:
    ((kind, body),) = d.items()
    return {"Jump": Jump, "Branch": Branch, "Return": Return}[kind](**body)


def to_dict(wf: Workflow) -> dict:
    ops = [
        {
            "literals": [{"output": x.output, "value": x.value} | ({"type": x.type} if x.type else {}) for x in op.literals],
            "phis": [{"output": p.output, "from": [list(s) for s in p.sources]} for p in op.phis],
            "call": {"task_id": op.call.task_id, "inputs": list(op.call.inputs), "outputs": list(op.call.outputs)} if op.call else None,
            "next": _next_to(op.next),
        }
        for op in wf.operations
    ]
    return {"name": wf.name, "operations": ops} | ({"params": [list(p) for p in wf.params]} if wf.params else {})


def from_dict(d: dict) -> Workflow:
    ops = tuple(
        Operation(
            tuple(Literal(x["output"], x["value"], x.get("type")) for x in o.get("literals", [])),
            tuple(Phi(p["output"], tuple((a, b) for a, b in p["from"])) for p in o.get("phis", [])),
            Call(o["call"]["task_id"], tuple(o["call"]["inputs"]), tuple(o["call"]["outputs"])) if o.get("call") else None,
            _next_from(o["next"]),
        )
        for o in d["operations"]
    )
    return Workflow(d["name"], ops, tuple((n, v) for n, v in d.get("params", [])))


def dumps(wf: Workflow) -> str:
    return json.dumps(to_dict(wf), indent=2, ensure_ascii=False)


def loads(text: str) -> Workflow:
    return from_dict(json.loads(text))


def export_all(workflows: dict[str, Workflow], folder: str) -> list[str]:
    """Write each workflow as <id>.workflow.ir.json; the paths."""
    paths = []
    Path(folder).mkdir(parents=True, exist_ok=True)
    for name, wf in sorted(workflows.items()):
        path = Path(folder, f"{name}.workflow.ir.json")
        path.write_text(dumps(wf), encoding="utf-8")
        paths.append(str(path))
    return paths
