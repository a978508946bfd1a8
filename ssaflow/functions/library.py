"""The shipped tasks: arithmetic, predicates, generators and examples of each kind.

Integers are 32-bit unless stated; overflow fails its own row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from ssaflow.operators.tasks import Task, TaskError, half_open, registry, task, user_type

_LOW, _HIGH = -(1 << 31), (1 << 31) - 1


def _checked(value: int) -> int:
    if not _LOW <= value <= _HIGH:
        raise TaskError("integer overflow")
    return value


def _arithmetic(name: str, arity: int, fn, expr) -> Task:
    """A task over integers whose overflow is a failure of its row."""

    def fails(*args):
        missing = args[0].isNull()
        for a in args[1:]:
            missing = missing | a.isNull()
        return expr(*args).isNull() & ~missing

    return registry.add(Task(name, "single", ("int",) * arity, ("int",), lambda *a: None if None in a else _checked(fn(*a)), expr, fails, "integer overflow"))


def _simple(name: str, inputs: tuple[str, ...], output: str, fn, expr) -> Task:
    return registry.add(Task(name, "single", inputs, (output,), lambda *a: None if None in a else fn(*a), expr))


add = _arithmetic("add", 2, lambda a, b: a + b, F.try_add)
double = _arithmetic("double", 1, lambda v: v * 2, lambda v: F.try_multiply(v, F.lit(2)))
multiply_by_two = _arithmetic("multiply_by_two", 1, lambda v: v * 2, lambda v: F.try_multiply(v, F.lit(2)))
multiply_by_3_and_add_1 = _arithmetic("multiply_by_3_and_add_1", 1, lambda n: n * 3 + 1, lambda n: F.try_add(F.try_multiply(n, F.lit(3)), F.lit(1)))
normalize = _arithmetic("normalize", 1, lambda v: v * 10, lambda v: F.try_multiply(v, F.lit(10)))
score = _arithmetic("score", 1, lambda v: v + 7, lambda v: F.try_add(v, F.lit(7)))
add_one = _arithmetic("add_one", 1, lambda v: v + 1, lambda v: F.try_add(v, F.lit(1)))
add_two = _arithmetic("add_two", 1, lambda v: v + 2, lambda v: F.try_add(v, F.lit(2)))

less_than = _simple("less_than", ("int", "int"), "boolean", lambda a, b: a < b, lambda a, b: a < b)
is_less = _simple("is_less", ("int", "int"), "boolean", lambda a, b: a < b, lambda a, b: a < b)
is_positive = _simple("is_positive", ("int",), "boolean", lambda v: v > 0, lambda v: v > 0)
is_negative = _simple("is_negative", ("int",), "boolean", lambda v: v < 0, lambda v: v < 0)
not_one = _simple("not_one", ("int",), "boolean", lambda v: v != 1, lambda v: v != 1)
is_even = _simple("is_even", ("int",), "boolean", lambda v: v % 2 == 0, lambda v: v % 2 == 0)
identity = _simple("identity", ("int",), "int", lambda v: v, lambda v: v)
#: Division of integers drops the fraction, toward zero.
divide_by_2 = _simple("divide_by_2", ("int",), "int", lambda v: -(-v // 2) if v < 0 else v // 2, lambda v: F.try_divide(v - F.try_mod(v, F.lit(2)), F.lit(2)))

#: The artifact's form: 64-bit, what isn't an integer counts as 0.
_as_integer = lambda x: F.coalesce(x.try_cast("bigint"), F.lit(0))
add_json = registry.add(Task("add_json", "single", ("string", "string"), ("bigint",), lambda a, b: _json_integer(a) + _json_integer(b), lambda a, b: _as_integer(a) + _as_integer(b)))


def _json_integer(text: str | None) -> int:
    try:
        value = int(text)
    except (TypeError, ValueError):
        return 0
    return value if -(1 << 63) <= value < 1 << 63 else 0


def _failing(name: str, bad: int) -> Task:
    def fn(v):
        if v == bad:
            raise TaskError("intentional failure")
        return v

    return registry.add(Task(name, "single", ("int",), ("int",), fn, lambda v: v, lambda v: v == bad, "intentional failure"))


maybe_fail = _failing("maybe_fail", 4)
maybe_fail_on_20 = _failing("maybe_fail_on_20", 20)


@task(inputs="int", output="int")
def panicker(v):
    """Must never run: shows that an arm not taken isn't evaluated."""
    raise RuntimeError("panicker ran")


def _stream(name: str, fn, expr, arity: int = 2) -> Task:
    return registry.add(Task(name, "stream", ("int",) * arity, ("int",), fn, expr))


range_by_10 = _stream("range", lambda a, b: [x * 10 for x in range(a, b)], lambda a, b: F.transform(half_open(a, b), lambda x: x * 10))
id_range = _stream("id_range", lambda a, b: range(a, b), half_open)
split = _stream("split", lambda n, k: range(n, n + k), lambda n, k: half_open(n, n + k))
stream_task = _stream("stream_task", lambda n: range(n), lambda n: half_open(F.lit(0), n), 1)

embed_batch = registry.add(Task("embed_batch", "batch", ("int",), ("int",), lambda rows: [v * 2 for v in rows], batch_size=4))
batch_task = registry.add(Task("batch_task", "batch", ("int",), ("int",), lambda rows: [v * 2 for v in rows]))

triple = registry.add(Task("triple", "single", ("int",), ("int", "boolean", "string"), lambda a: (a, a > 0, str(a)), lambda a: (a, a > 0, a.cast("string"))))
multiple_args_task = registry.add(Task("multiple_args_task", "single", ("int", "string"), ("string",), lambda a, b: f"{a}{b}", lambda a, b: F.concat(a.cast("string"), b)))
no_args_task = registry.add(Task("no_args_task", "single", (), ("void",), lambda: None, lambda: F.lit(None)))
action_if_true = registry.add(Task("action_if_true", "single", (), ("void",), lambda: None, lambda: F.lit(None)))


@user_type
@dataclass
class ComplexReturn:
    value: str


complex_return_task = registry.add(Task("complex_return_task", "single", ("int",), ("struct<value:string>",), lambda a: {"value": str(a)}, lambda a: F.struct(a.cast("string").alias("value"))))


class DoubleTask:
    """A loop of its own over the rows of a partition."""

    def run(self, rows):
        for context, value in rows:
            yield context, value * 2


double_direct = task("direct", inputs="int", output="int", name="double_direct")(DoubleTask)


#: Several values as one, the way they enter a task with one argument.
pack3 = registry.add(Task("pack3", "single", ("int", "boolean", "string"), ("struct<x:int,y:boolean,z:string>",), lambda x, y, z: {"x": x, "y": y, "z": z}, lambda x, y, z: F.struct(x.alias("x"), y.alias("y"), z.alias("z"))))

#: What infix operators in a workflow become.
OPERATORS = {
    "op_add": ("+", lambda a, b: a + b, F.try_add, None), "op_sub": ("-", lambda a, b: a - b, F.try_subtract, None),
    "op_mul": ("*", lambda a, b: a * b, F.try_multiply, None),
    "op_lt": ("<", lambda a, b: a < b, lambda a, b: a < b, "boolean"), "op_le": ("<=", lambda a, b: a <= b, lambda a, b: a <= b, "boolean"),
    "op_gt": (">", lambda a, b: a > b, lambda a, b: a > b, "boolean"), "op_ge": (">=", lambda a, b: a >= b, lambda a, b: a >= b, "boolean"),
    "op_eq": ("==", lambda a, b: a == b, lambda a, b: a == b, "boolean"), "op_ne": ("!=", lambda a, b: a != b, lambda a, b: a != b, "boolean"),
}
for _name, (_sign, _fn, _expr, _out) in OPERATORS.items():
    if _out:
        registry.add(Task(_name, "single", ("any", "any"), (_out,), _fn, _expr))
    else:
        registry.add(Task(_name, "single", ("any", "any"), ("any",), _fn, _expr, lambda a, b, _e=_expr: _e(a, b).isNull() & a.isNotNull() & b.isNotNull(), "integer overflow"))
registry.add(Task("op_not", "single", ("boolean",), ("boolean",), lambda a: not a, lambda a: ~a))
registry.add(Task("op_neg", "single", ("any",), ("any",), lambda a: -a, lambda a: -a))
