"""Workflows as DataFrames.

A context is a row, a value a column. Operations whose tasks have Column forms extend one frame, whatever branches lie
among them: each edge has a predicate, phis are CASE expressions, and nothing is split or united. Where a task needs
Python or makes more rows, the rows that come there are filtered out, run, and go on as a frame of their own.

Loops over literals alone are folded on the driver. Loops of Column forms become nested aggregations over constant
sequences, which stop at a row's exit and need no further job. Loops of functions that make no rows run to each row's
exit in one pass over Arrow batches. Other loops run in supersteps: the rows still active
are written to the shared folder, which cuts the lineage, until none is left.
"""

from __future__ import annotations

import bisect
import itertools
import tempfile
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ssaflow.checkpoints import materialise
from ssaflow.operators.tasks import Registry, Task, TaskError, call_plainly, call_together, chunks, is_async, packed, unpacked
from ssaflow.plans import interp, ir
from ssaflow.plans.analyze import Analysis, analyze, components, defined

#: Names of our columns; a root frame's own may be anything else.
VALUE, PATH, FAILURE = "__v{}", "__path", "struct<op:int,message:string>"
#: Steps of a Column loop on each of three nested levels; rows that need more fail.
LOOP_LEVEL = 100
#: Supersteps of other loops at most, None for any number.
MOST_SUPERSTEPS: int | None = None
#: Frames that are united without being written first.
MOST_UNITED = 16
#: Bytes of rows that a direct task's worker keeps in memory; those before are in scratch files.
HELD_BYTES = 64 << 20


#: Types whose values Python carries as Spark does, those of integers with their bits.
EXACT = {"boolean": 0, "string": 0, "int": 32, "bigint": 64}
#: The exit of rows that a loop over single rows leaves to supersteps.
AGAIN = -2


class LoopLimit(RuntimeError):
    """A loop with Python tasks or new rows took too many supersteps."""


@dataclass
class Frame:
    df: DataFrame
    env: dict[int, Column] = field(default_factory=dict)
    consts: dict[int, object] = field(default_factory=dict)
    #: Whether computing the frame again would run Python again.
    costly: bool = False
    names: int = 0

    def bind(self, value: Column) -> Column:
        """value as a column of its own, computed once."""
        self.names += 1
        name = f"__c{self.names}"
        self.df = self.df.withColumn(name, value)
        return F.col(name)


@dataclass
class Arrival:
    """Rows of a frame that come from an operation: all, or those of the predicate."""

    before: int | None
    frame: Frame
    when: Column | None = None

    def rows(self) -> DataFrame:
        return self.frame.df if self.when is None else self.frame.df.where(self.when)


def both(a: Column | None, b: Column | None) -> Column | None:
    return b if a is None else a if b is None else a & b


def either(conditions: list[Column | None]) -> Column | None:
    if any(c is None for c in conditions):
        return None
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


class Lowering:
    def __init__(self, wf: ir.Workflow, registry: Registry, root: DataFrame, keep: list[str], params: dict[str, str]) -> None:
        self.wf, self.registry, self.root, self.keep = wf, registry, root, keep
        kinds = dict(root.dtypes)
        self.a: Analysis = analyze(wf, registry, {n: kinds[c] for n, c in params.items()})
        self.streams = any(op.call and registry.get(op.call.task_id).kind == "stream" for k, op in enumerate(wf.operations) if k in self.a.reachable)
        self.params = params
        self.returns: list[tuple[Frame, Column | None, int | None]] = []
        self.failures: list[tuple[Frame, Column | None, int | Column, Column]] = []

    # ---- the frame -------------------------------------------------------------------------------------------------

    def base_columns(self) -> list[str]:
        return [*(f"__k{i}" for i in range(len(self.keep))), *([PATH] if self.streams else [])]

    def start(self) -> Frame:
        cols = [F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(self.keep)]
        cols += [F.array().cast("array<bigint>").alias(PATH)] if self.streams else []
        cols += [F.col(f"`{self.params[n]}`").alias(VALUE.format(v)) for n, v in self.wf.params]
        return Frame(self.root.select(*cols), {v: F.col(VALUE.format(v)) for _, v in self.wf.params})

    def const(self, value, kind: str) -> Column:
        return F.lit(value).cast(kind) if kind != "void" else F.lit(None)

    def column(self, frame: Frame, v: int) -> Column:
        if v in frame.consts:
            return self.const(frame.consts[v], self.a.types[v])
        return frame.env[v]

    def run(self) -> tuple[DataFrame, DataFrame]:
        self.region({0: [Arrival(None, self.start())]}, set(self.a.reachable), None)
        return self.results(), self.errors()

    # ---- regions ---------------------------------------------------------------------------------------------------

    def region(self, arrivals: dict[int, list[Arrival]], ops: set[int], header: int | None) -> dict[int, list[Arrival]]:
        """Run the operations of a region; edges into header, and out of the region, are given back."""
        out: dict[int, list[Arrival]] = defaultdict(list)
        pending: dict[int, list[Arrival]] = defaultdict(list, {k: list(v) for k, v in arrivals.items()})
        edges = {k: [s for s in self.wf.operations[k].successors() if s in ops and s != header] for k in ops}
        for comp in components(ops, edges):
            inside = set(comp)
            if not any(pending[k] for k in comp):
                continue
            if len(comp) == 1 and comp[0] not in edges[comp[0]]:
                left = self.operation(comp[0], self.meet(comp[0], pending.pop(comp[0])))
            else:
                left = self.loop(inside, {k: pending.pop(k) for k in comp if pending[k]})
            for target, more in left:
                (pending if target in ops and target != header else out)[target].append(more)
        return out

    def meet(self, at: int, arrivals: list[Arrival]) -> Arrival:
        """One arrival for all at an operation, its phis done."""
        phis = self.wf.operations[at].phis
        if all(a.frame is arrivals[0].frame for a in arrivals):
            frame = arrivals[0].frame
            values, consts = {}, {}
            for p in phis:
                sources = dict(p.sources)
                if len(arrivals) == 1:
                    v = sources.get(arrivals[0].before)
                    if v in frame.consts:
                        consts[p.output] = frame.consts[v]
                    elif v is not None:
                        values[p.output] = frame.env[v]
                    continue
                # all phis read what was before them
                made = F
                for a in arrivals[:-1]:
                    made = made.when(F.lit(True) if a.when is None else a.when, self.column(frame, sources[a.before]))
                values[p.output] = frame.bind(made.otherwise(self.column(frame, sources[arrivals[-1].before])).cast(self.a.types[p.output]))
            frame.env |= values
            frame.consts |= consts
            when = either([a.when for a in arrivals])
            if len(arrivals) > 1 and when is not None:
                # branches that meet again hold the rows that they parted from
                when = frame.bind(when)
            return Arrival(arrivals[-1].before, frame, when)
        return Arrival(None, self.unite(at, arrivals))

    def live(self, at: int) -> list[int]:
        """Values that an operation and what follows need, its phis' results among them."""
        return sorted(self.a.live_in[at] | {p.output for p in self.wf.operations[at].phis})

    def unite(self, at: int, arrivals: list[Arrival]) -> Frame:
        phis = {p.output: dict(p.sources) for p in self.wf.operations[at].phis}
        needed = self.live(at)
        shared = {}
        for v in needed:
            found = [a.frame.consts.get(phis[v].get(a.before) if v in phis else v, self) for a in arrivals]
            if all(f is not self and f == found[0] and type(f) is type(found[0]) for f in found):
                shared[v] = found[0]
        parts = []
        for group in self._by_frame(arrivals):
            df = None
            for a in group:
                sources = [F.lit(None) if (w := phis[v].get(a.before) if v in phis else v) is None else self.column(a.frame, w) for v in needed if v not in shared]
                cols = [c.cast(self._kind(v)).alias(VALUE.format(v)) for c, v in zip(sources, [v for v in needed if v not in shared], strict=True)]
                part = a.rows().select(*self.base_columns(), *cols)
                df = part if df is None else df.unionByName(part)
            parts.append(df)
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p)
        costly = any(a.frame.costly for a in arrivals)
        if len(arrivals) > MOST_UNITED:
            df, costly = materialise(df, "workflow"), False
        return Frame(df, {v: F.col(VALUE.format(v)) for v in needed if v not in shared}, shared, costly)

    def _kind(self, v: int) -> str:
        """The type that a value is stored with."""
        kind = self.a.types.get(v, "void")
        return "string" if kind in ("any", "void") else kind

    @staticmethod
    def _by_frame(arrivals: list[Arrival]) -> list[list[Arrival]]:
        groups: dict[int, list[Arrival]] = {}
        for a in arrivals:
            groups.setdefault(id(a.frame), []).append(a)
        return list(groups.values())

    # ---- operations ------------------------------------------------------------------------------------------------

    def operation(self, at: int, here: Arrival) -> list[tuple[int, Arrival]]:
        op = self.wf.operations[at]
        frame, when = here.frame, here.when
        for x in op.literals:
            frame.consts[x.output] = ir.parse_literal(x.value, x.type)[0]
        if op.call:
            frame, when = self.call(at, op.call, self.registry.get(op.call.task_id), frame, when)
        return self.leave(at, op.next, frame, when)

    def leave(self, at: int, following: ir.Next, frame: Frame, when: Column | None) -> list[tuple[int, Arrival]]:
        if isinstance(following, ir.Return):
            self.returns.append((frame, when, following.var))
            return []
        if isinstance(following, ir.Jump):
            return [(following.next, Arrival(at, frame, when))]
        if following.var in frame.consts:
            return [(following.true_next if frame.consts[following.var] else following.false_next, Arrival(at, frame, when))]
        flag = self.column(frame, following.var)
        if frame.costly:
            # two readers follow: Python shall not run for each
            frame = self.written(frame)
            flag = self.column(frame, following.var)
        yes, no = frame.bind(F.coalesce(both(when, flag), F.lit(False))), frame.bind(F.coalesce(both(when, ~flag), F.lit(False)))
        self.failures.append((frame, both(when, flag.isNull()), at, F.lit("a branch needs a boolean")))
        return [(following.true_next, Arrival(at, frame, yes)), (following.false_next, Arrival(at, frame, no))]

    def written(self, frame: Frame) -> Frame:
        """The frame read from the shared folder, under the same names."""
        frame.df, frame.costly = materialise(frame.df, "workflow"), False
        return frame

    def guarded(self, when: Column | None, value: Column) -> Column:
        """value where the predicate holds: a form that fails on a row isn't evaluated on an arm not taken."""
        return value if when is None else F.when(when, value)

    def call(self, at: int, call: ir.Call, task: Task, frame: Frame, when: Column | None) -> tuple[Frame, Column | None]:
        args = [self.column(frame, v) for v in call.inputs]
        if task.pure:
            made = [self.guarded(when, c).cast(self._kind(v)) for c, v in zip(task.columns(*args), call.outputs or [None], strict=True)] if call.outputs else []
            for v, c in zip(call.outputs, made, strict=True):
                frame.env[v] = frame.bind(c)
            if task.fails_when is not None:
                bad = frame.bind(F.coalesce(self.guarded(when, task.fails_when(*args)), F.lit(False)))
                self.failures.append((frame, both(when, bad), at, F.lit(task.message)))
                when = frame.bind(both(when, ~bad))
            return frame, when
        if not call.outputs and task.kind == "single" and task.fn is None:
            return frame, when
        df = frame.df if when is None else frame.df.where(when)
        # only what is needed from here on goes along
        alive = sorted((self.live_after(at) | set(call.inputs)) - set(call.outputs) - set(frame.consts))
        env = {v: F.col(VALUE.format(v)) for v in alive}
        df = df.select(*self.base_columns(), *(self.column(frame, v).alias(VALUE.format(v)) for v in alive if v in frame.env))
        fresh = Frame(df, {v: c for v, c in env.items() if v in frame.env}, dict(frame.consts), frame.costly)
        args = [self.column(fresh, v) for v in call.inputs]
        if task.kind == "stream" and task.expr is not None:
            self.explode(fresh, task.expr(*args), call.outputs[0])
            return fresh, None
        result = self.python(fresh, task, args, at, call)
        fresh.costly = True
        if task.kind == "stream":
            self.explode(fresh, result, None)
            result = F.col("__item")
        ok = result["message"].isNull()
        self.failures.append((fresh, ~ok, at, result["message"]))
        for k, v in enumerate(call.outputs):
            fresh.env[v] = result[f"_{k}"]
        return fresh, ok

    def live_after(self, at: int) -> set[int]:
        op = self.wf.operations[at]
        out = set()
        if isinstance(op.next, ir.Branch):
            out.add(op.next.var)
        if isinstance(op.next, ir.Return) and op.next.var is not None:
            out.add(op.next.var)
        for s in op.successors():
            out |= self.a.live_in[s] | {v for p in self.wf.operations[s].phis for b, v in p.sources if b == at}
        return out

    def explode(self, frame: Frame, items: Column, output: int | None) -> None:
        """A row for each item; its ordinal goes onto the context's path."""
        name = "__item" if output is None else VALUE.format(output)
        rest = [c for c in frame.df.columns if c not in (PATH, name)]
        df = frame.df.select(*rest, PATH, F.posexplode(items).alias("__at", name))
        frame.df = df.select(*rest, F.array_append(PATH, F.col("__at").cast("bigint")).alias(PATH), name)
        if output is not None:
            frame.env[output] = F.col(name)

    def python(self, frame: Frame, task: Task, args: list[Column], at: int, call: ir.Call) -> Column:
        """A struct of outputs and message for each row (for a stream an array of them), made by the task's function."""
        kinds = [self._kind(v) for v in call.outputs]
        body = ", ".join([*(f"_{k}: {t}" for k, t in enumerate(kinds)), "message: string"])
        item = f"struct<{body}>"
        frame.df = frame.df.select("*", F.struct(*(a.alias(f"a{k}") for k, a in enumerate(args))).alias("__args"))
        name = f"__r{at}"
        schema = T.StructType([*(f for f in frame.df.schema.fields if f.name != "__args"), T.StructField(name, T._parse_datatype_string(f"array<{item}>" if task.kind == "stream" else item))])
        frame.df = frame.df.mapInArrow(_python_rows(task, len(args), kinds, name), schema)
        return F.col(name)

    # ---- loops -----------------------------------------------------------------------------------------------------

    def loop(self, ops: set[int], arrivals: dict[int, list[Arrival]]) -> list[tuple[int, Arrival]]:
        if len(arrivals) != 1:
            raise ir.InvalidWorkflow("a loop is entered in more than one place")
        ((header, entering),) = arrivals.items()
        if (folded := self.fold(header, ops, entering)) is not None:
            return folded
        if self.columnar(header, ops):
            return self.column_loop(header, ops, entering)
        if self.row_local(header, ops):
            return self.row_loop(header, ops, entering)
        return self.supersteps(header, ops, entering)

    def fold(self, header: int, ops: set[int], entering: list[Arrival]) -> list[tuple[int, Arrival]] | None:
        """A loop whose inputs are literals runs once, on the driver."""
        if len(entering) != 1:
            return None
        here = entering[0]
        before = here.before
        needed = self.a.live_in[header] | {dict(p.sources)[before] for p in self.wf.operations[header].phis}
        within = {v for k in ops for v in defined(self.wf.operations[k])}
        reads = {v for k in ops for v in (set(self.wf.operations[k].call.inputs) if self.wf.operations[k].call else set())} | {dict(p.sources)[before] for p in self.wf.operations[header].phis}
        tasks = [self.registry.get(self.wf.operations[k].call.task_id) for k in ops if self.wf.operations[k].call]
        if not (needed & reads) - within <= set(here.frame.consts) or not all(t.kind == "single" and t.fn for t in tasks):
            return None
        values, at, steps = dict(here.frame.consts), header, 0
        while at in ops:
            op = self.wf.operations[at]
            values = interp.step(op, values, before)
            try:
                if op.call:
                    task = self.registry.get(op.call.task_id)
                    values |= dict(zip(op.call.outputs, unpacked(call_plainly(task, [values[v] for v in op.call.inputs]), len(op.call.outputs)), strict=True))
            except Exception as e:  # noqa: BLE001
                self.failures.append((here.frame, here.when, at, F.lit(str(e))))
                return []
            before, at = at, interp.following(op, values)
            steps += 1
            if steps > LOOP_LEVEL**3:
                self.failures.append((here.frame, here.when, header, F.lit(f"the loop at operation {header} doesn't end")))
                return []
            if at is None:
                here.frame.consts |= values
                return self.leave(before, op.next, here.frame, here.when)
        here.frame.consts |= values
        return [(at, Arrival(before, here.frame, here.when))]

    def columnar(self, header: int, ops: set[int]) -> bool:
        """Whether a loop, and any loop inside, has Column forms only and no return."""
        mine = [self.wf.operations[k] for k in ops]
        if not all(not isinstance(o.next, ir.Return) and (o.call is None or self.registry.get(o.call.task_id).pure) for o in mine):
            return False
        inner = [set(c) for c in components(ops, self.inside(header, ops)) if self.is_loop(c, ops, header)]
        return all((h := self.entry_of(c)) is not None and self.columnar(h, c) for c in inner)

    def inside(self, header: int, ops: set[int]) -> dict[int, list[int]]:
        """Edges of a loop without those back to its header."""
        return {k: [s for s in self.wf.operations[k].successors() if s in ops and s != header] for k in ops}

    def is_loop(self, comp: list[int], ops: set[int], header: int) -> bool:
        return len(comp) > 1 or comp[0] in self.inside(header, ops)[comp[0]]

    def entry_of(self, comp: set[int]) -> int | None:
        """The operation where a loop is entered, if it is one."""
        found = [k for k in comp if self.a.predecessors.get(k, set()) - comp]
        return found[0] if len(found) == 1 else None

    def turns(self, header: int, ops: set[int], env: dict[int, Column], first: dict[int, Column]) -> tuple[Column, list[int], list[tuple[int, int]]]:
        """A Column loop's state after its last turn; the values that it has as fields, and the edges that leave it.

        first has the header's phis at the entry, env whatever else is read in the loop.
        """
        within = {v for k in ops for v in defined(self.wf.operations[k])}
        exits = [(k, s) for k in sorted(ops) for s in self.wf.operations[k].successors() if s not in ops]
        # what is defined in the loop and read after it
        after = {v for k, s in exits for v in self.a.live_in[s] | {v for p in self.wf.operations[s].phis for b, v in p.sources if b == k}}
        fields = list(first) + sorted((after & within) - set(first))
        outside = {v: c for v, c in env.items() if v not in within}
        start = [first.get(v, F.lit(None)).cast(self._kind(v)).alias(f"f{v}") for v in fields]
        state = F.struct(*start, F.lit(-1).alias("exit"), F.lit(None).cast(FAILURE).alias("failure"))
        once = lambda s, _: F.when(self.over(s), s).otherwise(self.body(header, ops, exits, fields, outside, s))
        level = lambda s: F.aggregate(F.sequence(F.lit(1), F.lit(LOOP_LEVEL)), s, once)
        twice = lambda s, _: F.when(self.over(s), s).otherwise(level(s))
        more = lambda s: F.aggregate(F.sequence(F.lit(1), F.lit(LOOP_LEVEL)), s, twice)
        thrice = lambda s, _: F.when(self.over(s), s).otherwise(more(s))
        return F.aggregate(F.sequence(F.lit(1), F.lit(LOOP_LEVEL)), state, thrice), fields, exits

    @staticmethod
    def over(state: Column) -> Column:
        return (state["exit"] >= 0) | state["failure"].isNotNull()

    def endless(self, header: int) -> Column:
        return F.lit(f"the loop at operation {header} doesn't end")

    def column_loop(self, header: int, ops: set[int], entering: list[Arrival]) -> list[tuple[int, Arrival]]:
        here = self.meet(header, entering)
        frame, when = here.frame, here.when
        env = {v: self.column(frame, v) for v in set(frame.env) | set(frame.consts)}
        first = {p.output: self.column(frame, p.output) for p in self.wf.operations[header].phis}
        end, fields, exits = self.turns(header, ops, env, first)
        end = frame.bind(self.guarded(when, end))
        for v in fields:
            frame.env[v] = end[f"f{v}"]
            frame.consts.pop(v, None)
        self.failures.append((frame, both(when, end["failure"].isNotNull()), header, end["failure"]["message"]))
        self.failures.append((frame, both(when, ~self.over(end)), header, self.endless(header)))
        return [(s, Arrival(k, frame, frame.bind(F.coalesce(both(when, end["exit"] == n), F.lit(False))))) for n, (k, s) in enumerate(exits)]

    def body(self, header: int, ops: set[int], exits: list[tuple[int, int]], fields: list[int], outside: dict[int, Column], s: Column) -> Column:
        """The state after one turn of a Column loop."""
        order = components(ops, self.inside(header, ops))
        phis = {p.output: dict(p.sources) for p in self.wf.operations[header].phis}

        def merged(at: int, arrived: list[tuple[int, Column | None]], env: dict[int, Column]) -> dict[int, Column]:
            made = {}
            for p in self.wf.operations[at].phis:
                sources, value = dict(p.sources), F
                arrived = [(b, w) for b, w in arrived if b in sources]
                for b, w in arrived[:-1]:
                    value = value.when(F.lit(True) if w is None else w, env[sources[b]])
                last = env[sources[arrived[-1][0]]]
                made[p.output] = last if value is F else value.otherwise(last)
            return made

        def walk(n: int, env: dict[int, Column], coming: dict, exit_at: Column, failure: Column, back: list) -> Column:
            env, coming, back = dict(env), {k: list(v) for k, v in coming.items()}, list(back)
            for place in range(n, len(order)):
                comp = order[place]
                arrived = [(k, a) for k in comp for a in coming.get(k, [])]
                if not arrived:
                    continue
                if self.is_loop(comp, ops, header):
                    # the rest of the turn sees the inner loop's end as a variable: it runs once
                    inner = arrived[0][0]
                    when = either([w for _, (_, w) in arrived])
                    end, kept, ways = self.turns(inner, set(comp), env, merged(inner, [a for _, a in arrived], env))

                    def rest(e: Column, place=place, inner=inner, when=when, kept=kept, ways=ways, env=env, coming=coming, exit_at=exit_at, failure=failure, back=back) -> Column:
                        bad = F.when(e["failure"].isNotNull(), e["failure"]).when(~self.over(e), F.struct(F.lit(inner).alias("op"), self.endless(inner).alias("message")))
                        failed = F.when(F.lit(True) if when is None else when, F.coalesce(bad, failure)).otherwise(failure)
                        left = [(k, t, both(when, F.coalesce(e["exit"] == i, F.lit(False)))) for i, (k, t) in enumerate(ways)]
                        return leave(place, env | {v: e[f"f{v}"] for v in kept}, coming, exit_at, failed, back, left)

                    return F.transform(F.array(self.guarded(when, end)), lambda e: rest(e))[0]  # noqa: B023
                (k,) = comp
                op = self.wf.operations[k]
                when = either([w for _, (_, w) in arrived])
                if k != header:
                    env |= merged(k, [a for _, a in arrived], env)
                for x in op.literals:
                    env[x.output] = self.const(*ir.parse_literal(x.value, x.type))
                if op.call:
                    task = self.registry.get(op.call.task_id)
                    args = [env[v] for v in op.call.inputs]
                    if op.call.outputs:
                        env |= {v: self.guarded(when, c).cast(self._kind(v)) for v, c in zip(op.call.outputs, task.columns(*args), strict=True)}
                    if task.fails_when is not None:
                        bad = F.coalesce(task.fails_when(*args), F.lit(False))
                        failure = F.when(both(when, bad), F.struct(F.lit(k).alias("op"), F.lit(task.message).alias("message"))).otherwise(failure)
                        when = both(when, ~bad)
                if isinstance(op.next, ir.Branch):
                    flag = env[op.next.var]
                    failure = F.when(both(when, flag.isNull()), F.struct(F.lit(k).alias("op"), F.lit("a branch needs a boolean").alias("message"))).otherwise(failure)
                    ways = [(k, op.next.true_next, both(when, F.coalesce(flag, F.lit(False)))), (k, op.next.false_next, both(when, F.coalesce(~flag, F.lit(False))))]
                else:
                    ways = [(k, op.next.next, when)]
                exit_at = taken(ways, coming, exit_at, back)
            new = []
            for v in fields:
                value = s[f"f{v}"] if v in phis or v not in env else env[v]
                if v in phis:
                    for b, w in back:
                        value = F.when(F.lit(True) if w is None else w, env[phis[v][b]]).otherwise(value)
                new.append(value.cast(self._kind(v)).alias(f"f{v}"))
            return F.struct(*new, exit_at.alias("exit"), failure.alias("failure"))

        def taken(ways: list[tuple[int, int, Column | None]], coming: dict, exit_at: Column, back: list) -> Column:
            for k, target, w in ways:
                if target == header:
                    back.append((k, w))
                elif target in ops:
                    coming.setdefault(target, []).append((k, w))
                else:
                    exit_at = F.when(F.lit(True) if w is None else w, F.lit(exits.index((k, target)))).otherwise(exit_at)
            return exit_at

        def leave(place: int, env: dict, coming: dict, exit_at: Column, failure: Column, back: list, ways: list) -> Column:
            coming, back = {k: list(v) for k, v in coming.items()}, list(back)
            exit_at = taken(ways, coming, exit_at, back)
            return walk(place + 1, env, coming, exit_at, failure, back)

        env = outside | {v: s[f"f{v}"] for v in fields}
        return walk(0, env, {header: [(None, None)]}, F.lit(-1), F.lit(None).cast(FAILURE), [])

    def row_local(self, header: int, ops: set[int]) -> bool:
        """Whether a loop makes no rows and has plain functions only, over values that are the same in Python."""
        mine = [self.wf.operations[k] for k in ops]
        if any(isinstance(o.next, ir.Return) for o in mine):
            return False
        tasks = [self.registry.get(o.call.task_id) for o in mine if o.call]
        made = {v for o in mine for v in defined(o)} | set(self.live(header))
        return all(t.kind in ("single", "batch") and t.fn is not None and not is_async(t) for t in tasks) and all(self._kind(v) in EXACT for v in made)

    def row_loop(self, header: int, ops: set[int], entering: list[Arrival]) -> list[tuple[int, Arrival]]:
        """Run each row's turns to its exit in one pass; a row whose values Python can't carry as Spark does goes by supersteps."""
        start = self.unite(header, entering)
        given = [v for v in self.live(header) if v not in start.consts]
        within = {v for k in ops for v in defined(self.wf.operations[k])}
        exits = [(k, s) for k in sorted(ops) for s in self.wf.operations[k].successors() if s not in ops]
        after = {v for _, s in exits for v in self.a.live_in[s]} | {v for k, s in exits for p in self.wf.operations[s].phis for b, v in p.sources if b == k}
        fields = sorted(after & within)
        kinds = {v: self._kind(v) for v in within | set(given)}
        df = start.df.select("*", F.struct(*(start.env[v].alias(f"a{v}") for v in given), F.lit(None).cast("int").alias("a")).alias("__args"))
        ended = T._parse_datatype_string(f"struct<{', '.join([*(f'f{v}: {kinds[v]}' for v in fields), 'exit: int, op: int, message: string'])}>")
        name = f"__l{header}"
        schema = T.StructType([*(f for f in df.schema.fields if f.name != "__args"), T.StructField(name, ended)])
        tasks = {k: self.registry.get(self.wf.operations[k].call.task_id) for k in ops if self.wf.operations[k].call}
        turned = _loop_rows({k: self.wf.operations[k] for k in ops}, tasks, header, given, dict(start.consts), fields, kinds, exits, ended, name)
        # exits, failures and what goes by supersteps read it: Python shall not run for each
        frame = self.written(Frame(df.mapInArrow(turned, schema), dict(start.env), dict(start.consts)))
        end = F.col(name)
        self.failures.append((frame, end["message"].isNotNull(), end["op"], end["message"]))
        out: list[tuple[int, Arrival]] = []
        rest = frame.df.where(end["exit"] == AGAIN)
        if not rest.isEmpty():
            out += self.supersteps(header, ops, [], Frame(rest, dict(start.env), dict(start.consts)))
        for v in fields:
            frame.env[v] = end[f"f{v}"]
            frame.consts.pop(v, None)
        return out + [(s, Arrival(k, frame, frame.bind(F.coalesce(end["exit"] == n, F.lit(False))))) for n, (k, s) in enumerate(exits)]

    def supersteps(self, header: int, ops: set[int], entering: list[Arrival], start: Frame | None = None) -> list[tuple[int, Arrival]]:
        """Run the body over all active rows at a time until none is left. start has them where they are at the header already."""
        out: list[tuple[int, Arrival]] = []
        waiting: dict[int, list[Arrival]] = defaultdict(list)
        for turn in itertools.count():
            frame = start if start and not turn else self.unite(header, entering)
            df = materialise(frame.df, "superstep")
            if df.isEmpty():
                break
            if turn == MOST_SUPERSTEPS:
                raise LoopLimit(f"the loop at operation {header} took more than {MOST_SUPERSTEPS} supersteps")
            here = Frame(df, dict(frame.env), dict(frame.consts))
            left = self.region_from(header, ops, here)
            entering = left.pop(header, [])
            for target, more in left.items():
                waiting[target] += more
                if len(waiting[target]) > MOST_UNITED:
                    self.pool(waiting, target)
            if not entering:
                break
        for target, more in waiting.items():
            out += [(target, a) for a in more]
        return out

    def region_from(self, header: int, ops: set[int], frame: Frame) -> dict[int, list[Arrival]]:
        """One turn of a loop: the header's phis are done, its operations run, edges back to it are given back."""
        first = self.operation(header, Arrival(None, frame))
        out: dict[int, list[Arrival]] = defaultdict(list)
        inner: dict[int, list[Arrival]] = defaultdict(list)
        for target, a in first:
            (inner if target in ops and target != header else out)[target].append(a)
        for target, more in self.region(inner, ops - {header}, header).items():
            out[target] += more
        return out

    def pool(self, waiting: dict[int, list[Arrival]], target: int) -> None:
        """Write rows that have left a loop, by the operation that they come from."""
        by_source: dict[int | None, list[Arrival]] = defaultdict(list)
        for a in waiting[target]:
            by_source[a.before].append(a)
        waiting[target] = []
        for before, group in by_source.items():
            phis = {v for p in self.wf.operations[target].phis for b, v in p.sources if b == before}
            needed = sorted(self.a.live_in[target] | phis)
            df = None
            for a in group:
                part = a.rows().select(*self.base_columns(), *(self.column(a.frame, v).cast(self._kind(v)).alias(VALUE.format(v)) for v in needed))
                df = part if df is None else df.unionByName(part)
            waiting[target].append(Arrival(before, Frame(materialise(df, "left-loop"), {v: F.col(VALUE.format(v)) for v in needed})))

    # ---- what comes out --------------------------------------------------------------------------------------------

    def named(self) -> list[Column]:
        return [*(F.col(f"__k{i}").alias(c) for i, c in enumerate(self.keep)), *([F.col(PATH).alias("ctx_path")] if self.streams else [])]

    def results(self) -> DataFrame:
        kinds = {self.a.types.get(v, "void") for _, _, v in self.returns if v is not None} or {"void"}
        kinds -= {"void"} if len(kinds) > 1 else set()
        if len(kinds) > 1:
            raise ir.InvalidWorkflow(f"the workflow returns {', '.join(sorted(kinds))}")
        (kind,) = kinds
        frames: dict[int, list[tuple[Frame, Column | None, int | None]]] = {}
        for r in self.returns:
            frames.setdefault(id(r[0]), []).append(r)
        out = None
        for group in frames.values():
            frame = group[0][0]
            value = F
            for _, when, v in group[:-1]:
                value = value.when(F.lit(True) if when is None else when, F.lit(None) if v is None else self.column(frame, v))
            last = F.lit(None) if group[-1][2] is None else self.column(frame, group[-1][2])
            value = last if value is F else value.otherwise(last)
            when = either([w for _, w, _ in group])
            rows = frame.df if when is None else frame.df.where(when)
            part = rows.select(*self.named(), (value if kind == "void" else value.cast(kind)).alias("result"))
            out = part if out is None else out.unionByName(part)
        if out is None:
            out = self.root.limit(0).select(*(F.col(f"`{c}`") for c in self.keep), *([F.array().cast("array<bigint>").alias("ctx_path")] if self.streams else []), F.lit(None).alias("result"))
        return out

    def errors(self) -> DataFrame:
        """op and message of each row that failed, beside what the root frame keeps."""
        out = None
        for frame, when, at, message in self.failures:
            rows = frame.df if when is None else frame.df.where(when)
            part = rows.select(*self.named(), (at if isinstance(at, Column) else F.lit(at)).alias("op"), message.cast("string").alias("message"))
            out = part if out is None else out.unionByName(part)
        if out is None:
            out = self.root.limit(0).select(*(F.col(f"`{c}`") for c in self.keep), *([F.array().cast("array<bigint>").alias("ctx_path")] if self.streams else []), F.lit(0).alias("op"), F.lit("").alias("message"))
        return out


class _Held:
    """The rows that a direct task has taken, by number: it may emit any of them until its partition ends."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.batches: list[pa.RecordBatch] = []
        self.count = self.size = self.written = 0
        self.scratch = tempfile.TemporaryDirectory(prefix="ssaflow-held-")

    def add(self, batch: pa.RecordBatch) -> int:
        """The number of the batch's first row."""
        first = self.count
        self.starts.append(first)
        self.batches.append(batch)
        self.count, self.size = first + batch.num_rows, self.size + batch.nbytes
        if self.size > HELD_BYTES:
            self._write()
        return first

    def _write(self) -> None:
        path = f"{self.scratch.name}/{self.written}"
        with pa.ipc.new_file(path, self.batches[self.written].schema) as out:
            for batch in self.batches[self.written :]:
                out.write_batch(batch)
        mapped = pa.ipc.open_file(pa.memory_map(path))
        self.batches[self.written :] = [mapped.get_batch(k) for k in range(mapped.num_record_batches)]
        self.written, self.size = len(self.batches), 0

    def row(self, k: int) -> pa.RecordBatch:
        if not 0 <= k < self.count:
            raise TaskError(f"no row {k} has been given")
        at = bisect.bisect_right(self.starts, k) - 1
        return self.batches[at].slice(k - self.starts[at], 1)


def _python_rows(task: Task, n_args: int, kinds: list[str], name: str):
    """Run a task's function over Arrow batches; a row's exception is its message."""
    n_out = len(kinds)

    def told(e: Exception) -> str:
        return str(e) or type(e).__name__

    def good(value) -> dict:
        return {**{f"_{k}": v for k, v in enumerate(unpacked(value, n_out))}, "message": None}

    def bad(e: Exception) -> dict:
        return {**{f"_{k}": None for k in range(n_out)}, "message": told(e)}

    def one(args: tuple) -> dict:
        try:
            return good(task.fn(*args))
        except Exception as e:  # noqa: BLE001  whatever a task raises fails its row
            return bad(e)

    def stream(args: tuple) -> list[dict]:
        items = []
        try:
            for value in task.fn(*args):
                items.append(bad(value) if isinstance(value, Exception) else good(value))
        except Exception as e:  # noqa: BLE001
            items.append(bad(e))
        return items

    def together(rows: list[tuple]) -> list:
        made = []
        for r in call_together(task, rows):
            if task.kind == "single":
                made.append(outcome(r))
            else:
                made.append([bad(r)] if isinstance(r, Exception) else [outcome(v) for v in r])
        return made

    def outcome(value) -> dict:
        try:
            return bad(value) if isinstance(value, Exception) else good(value)
        except TaskError as e:
            return bad(e)

    def chunked(rows: list[tuple]) -> list[dict]:
        out = []
        for chunk in chunks(rows, task.batch_size):
            try:
                made = list(call_plainly(task, [[packed(r) for r in chunk]]))
                if len(made) != len(chunk):
                    raise TaskError(f"{len(made)} results for {len(chunk)} rows")
                out += [bad(v) if isinstance(v, Exception) else good(v) for v in made]
            except Exception as e:  # noqa: BLE001
                out += [bad(e)] * len(chunk)
        return out

    def arguments(batch: pa.RecordBatch) -> list[tuple]:
        at = batch.schema.get_field_index("__args")
        rows = batch.column(at).to_pylist() if n_args else [{}] * batch.num_rows
        return [tuple(r[f"a{k}"] for k in range(n_args)) for r in rows]

    def without(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.select([n for n in batch.schema.names if n != "__args"])

    def with_result(batch: pa.RecordBatch, made: list) -> pa.RecordBatch:
        rest = without(batch)
        return pa.RecordBatch.from_arrays([*rest.columns, pa.array(made, kind)], [*rest.schema.names, name])

    item = pa.struct([*(pa.field(f"_{k}", to_arrow_type(T._parse_datatype_string(t))) for k, t in enumerate(kinds)), pa.field("message", pa.string())])
    kind = pa.list_(item) if task.kind == "stream" else item

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if task.prepare:
            task.prepare()
        if task.kind == "direct":
            yield from direct(it)
            return
        for batch in it:
            args = arguments(batch)
            if is_async(task) and task.kind != "batch":
                yield with_result(batch, together(args))
                continue
            yield with_result(batch, chunked(args) if task.kind == "batch" else [stream(a) if task.kind == "stream" else one(a) for a in args])

    def direct(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the task's own loop pulls rows; what it emits, however late, joins the row that it names
        held, silent = _Held(), {}
        ended, broken = False, None

        def feed():
            for batch in it:
                if batch.num_rows:
                    first = held.add(batch)
                    yield from ((first + k, packed(args)) for k, args in enumerate(arguments(batch)))

        source = feed()

        def rows():
            nonlocal ended, broken
            while True:
                try:
                    k, args = next(source)
                except StopIteration:
                    ended = True
                    return
                except Exception as e:
                    broken = e
                    raise
                silent[k] = None
                yield k, args

        def emitted():
            while not ended:
                silent.clear()
                try:
                    made = task.fn()
                    if hasattr(made, "prepare"):
                        made.prepare()
                    for context, value in made.run(rows()):
                        yield held.row(context), bad(value) if isinstance(value, Exception) else good(value)
                        silent.pop(context, None)
                    return
                except Exception as e:  # noqa: BLE001
                    # what the loop took without an answer fails, and it starts again for the rest
                    if broken is not None or ended and not silent:
                        raise
                    if not silent:
                        next(rows(), None)
                    yield from ((held.row(k), bad(e)) for k in list(silent))

        for group in chunks(emitted(), 1024):
            yield with_result(pa.Table.from_batches([b for b, _ in group]).combine_chunks().to_batches()[0], [v for _, v in group])

    return run


def _same(value, kind: str) -> bool:
    """Whether a value that Python has made is one of the type as it stands."""
    if value is None:
        return True
    if bits := EXACT[kind]:
        return type(value) is int and -(1 << bits - 1) <= value < 1 << bits - 1
    return type(value) is (bool if kind == "boolean" else str)


def _loop_rows(ops: dict[int, ir.Operation], tasks: dict[int, Task], header: int, given: list[int], consts: dict, fields: list[int], kinds: dict[int, str], exits: list[tuple[int, int]], ended: T.StructType, name: str):
    """Run a loop for each row of Arrow batches, and give its exit, the values after it, or its failure."""
    exit_of = {e: n for n, e in enumerate(exits)}
    literals = {k: {x.output: ir.parse_literal(x.value, x.type)[0] for x in op.literals} for k, op in ops.items()}
    phis = {k: [(p.output, dict(p.sources)) for p in op.phis] for k, op in ops.items()}
    nothing = {**{f"f{v}": None for v in fields}, "exit": -1, "op": None, "message": None}

    def results(at: int, ready: list[tuple[int, tuple]]) -> Iterator:
        """The task's result or exception for each row; batches are as large as what waits here."""
        task = tasks[at]
        if task.kind == "single":
            for _, args in ready:
                try:
                    yield task.fn(*args)
                except Exception as e:  # noqa: BLE001  whatever a task raises fails its row
                    yield e
            return
        for chunk in chunks(ready, task.batch_size):
            try:
                made = list(call_plainly(task, [[packed(args) for _, args in chunk]]))
                if len(made) != len(chunk):
                    raise TaskError(f"{len(made)} results for {len(chunk)} rows")
            except Exception as e:  # noqa: BLE001
                made = [e] * len(chunk)
            yield from made

    def called(at: int, here: list[int], rows: list[dict], done: list) -> list[int]:
        """The rows that go on after the call."""
        task, call, left = tasks[at], ops[at].call, []
        ready = [(r, tuple(rows[r][v] for v in call.inputs)) for r in here]
        for r, args in ready:
            if task.pure and None in args:
                done[r] = nothing | {"exit": AGAIN}
        ready = [x for x in ready if done[x[0]] is None]
        for (r, _), value in zip(ready, results(at, ready), strict=True):
            try:
                if isinstance(value, Exception):
                    raise value
                made = unpacked(value, len(call.outputs))
            except Exception as e:  # noqa: BLE001
                done[r] = nothing | ({"exit": AGAIN} if task.pure else {"op": at, "message": str(e) or type(e).__name__})
                continue
            if not all(_same(x, kinds[v]) for v, x in zip(call.outputs, made, strict=True)):
                done[r] = nothing | {"exit": AGAIN}
                continue
            rows[r].update(zip(call.outputs, made, strict=True))
            left.append(r)
        return left

    def turned(rows: list[dict]) -> list[dict]:
        done: list = [None] * len(rows)
        came: list = [None] * len(rows)
        waiting = {header: list(range(len(rows)))} if rows else {}
        while waiting:
            at = max(waiting, key=lambda k: len(waiting[k]))
            here, op = waiting.pop(at), ops[at]
            for r in here:
                if phis[at] and came[r] is not None:
                    rows[r].update([(v, rows[r][sources[came[r]]]) for v, sources in phis[at]])
                rows[r].update(literals[at])
            for r in called(at, here, rows, done) if op.call else here:
                try:
                    following = interp.following(op, rows[r])
                except TypeError as e:
                    done[r] = nothing | {"op": at, "message": str(e)}
                    continue
                if following in ops:
                    came[r] = at
                    waiting.setdefault(following, []).append(r)
                else:
                    done[r] = {**{f"f{v}": rows[r].get(v) for v in fields}, "exit": exit_of[at, following], "op": None, "message": None}
        return done

    kind = to_arrow_type(ended)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in tasks.values():
            if task.prepare:
                task.prepare()
        for batch in it:
            args = batch.column(batch.schema.get_field_index("__args")).to_pylist()
            made = turned([{**consts, **{v: r[f"a{v}"] for v in given}} for r in args])
            rest = batch.select([n for n in batch.schema.names if n != "__args"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(made, kind)], [*rest.schema.names, name])

    return run
