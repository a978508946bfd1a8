"""The workflows behind the queries and the examples."""

from __future__ import annotations

from ssaflow.functions.library import (
    action_if_true, add, add_one, batch_task, complex_return_task, divide_by_2, double, double_direct, embed_batch, id_range, identity, is_even, is_negative, is_positive,
    less_than, maybe_fail, maybe_fail_on_20, multiple_args_task, multiply_by_3_and_add_1, multiply_by_two, normalize, not_one, pack3, panicker, range_by_10, score, split, stream_task, triple,
)
from ssaflow.plans.trace import workflow


@workflow
def simple():
    a = 1
    b = 2
    return add(a, b)


@workflow
def fibonacci():
    a = 0
    b = 1
    while less_than(a, 10):
        c = add(a, b)
        a = b
        b = c
    return b


@workflow
def list_workflow():
    return split(range_by_10(1, 4), 3)


@workflow
def stream_failure():
    return maybe_fail_on_20(range_by_10(1, 4))


@workflow
def direct():
    return double_direct(4)


@workflow
def conditional():
    value = 10
    return double(value) if is_positive(value) else identity(value)


@workflow
def else_if():
    value = 10
    return double(value) if is_positive(value) else double(value) if is_negative(value) else identity(value)


@workflow
def while_loop():
    i = 0
    while less_than(i, 3):
        i = add(i, 1)
    return i


@workflow
def conditional_in_while_loop():
    n = 6
    count = 0
    while not_one(n):
        if is_even(n):
            n = divide_by_2(n)
        else:
            n = multiply_by_3_and_add_1(n)
        count = add(count, 1)
    return count


@workflow
def multiple_mutable():
    a = 0
    b = 1
    i = 0
    while less_than(i, 5):
        t = add(a, b)
        a = b
        b = t
        i = add(i, 1)
    return a


@workflow
def nested_if_in_while():
    i = 0
    while less_than(i, 10):
        if is_even(i):
            i = add(i, 2)
        else:
            i = add(i, 1)
    return i


@workflow
def chained():
    return multiply_by_two(add_one(5))


@workflow
def simple_return():
    return 123


@workflow
def etl_pipeline():
    ids = id_range(1, 6)
    cleaned = normalize(ids)
    scored = score(cleaned)
    bonus = 0
    step = 0
    while less_than(step, 3):
        bonus = add(bonus, step)
        step = add(step, 1)
    return add(scored, bonus) if is_even(scored) else scored


@workflow
def ml_pipeline():
    tokens = id_range(1, 10)
    embedded = embed_batch(tokens)
    scored = score(embedded)
    return add(scored, 1) if is_even(scored) else scored


@workflow
def media_pipeline():
    frames = id_range(1, 6)
    processed = maybe_fail(frames)
    return score(processed)


# ---- the same over the rows of a root frame --------------------------------------------------------------------------


@workflow
def single_chain(o_custkey):
    return multiply_by_two(add_one(o_custkey))


@workflow
def if_else_value(o_custkey):
    return o_custkey * 2 if o_custkey > 700 else o_custkey


@workflow
def else_if_value(o_custkey):
    return o_custkey * 2 if o_custkey > 1000 else o_custkey * 2 if o_custkey < 300 else o_custkey


@workflow
def parity(o_orderkey):
    if is_even(o_orderkey):
        arm = "then"
    else:
        arm = "else"
    return arm


@workflow
def while_rows(p_size):
    i = p_size - p_size
    while less_than(i, 10):
        if is_even(i):
            i = add(i, 2)
        else:
            i = add(i, 1)
    return i


@workflow
def collatz(n):
    count = 0
    while not_one(n):
        if is_even(n):
            n = divide_by_2(n)
        else:
            n = multiply_by_3_and_add_1(n)
        count = add(count, 1)
    return count


@workflow
def stream_range(n_regionkey):
    return id_range(0, n_regionkey)


@workflow
def stream_stream(n_regionkey):
    return split(range_by_10(0, n_regionkey), 3)


@workflow
def batch_x2(label):
    return embed_batch(label)


@workflow
def direct_x2(label):
    return double_direct(label)


@workflow
def etl_on_rows(v):
    scored = score(normalize(v))
    bonus = 0
    step = 0
    while less_than(step, 3):
        bonus = add(bonus, step)
        step = add(step, 1)
    return add(scored, bonus) if is_even(scored) else scored


@workflow
def etl_even_arm(v):
    scored = score(v)
    bonus = 0
    step = 0
    while less_than(step, 3):
        bonus = add(bonus, step)
        step = add(step, 1)
    return add(scored, bonus) if is_even(scored) else scored


@workflow
def media_on_rows(n_nationkey):
    return score(maybe_fail(n_nationkey))


@workflow
def tagged(o_custkey):
    x, _, z = triple(o_custkey)
    return pack3(x, x > 750, z)


@workflow
def untaken_arm(v):
    # Python that must not run for the rows of the other arm
    return panicker(v) if v > 1_000_000 else identity(v)


@workflow
def filter_by_fan_out(v):
    # an even value has one item, an odd one none
    keep = 1 if is_even(v) else 0
    k = id_range(0, keep)
    return v


@workflow
def theta_join(v):
    b = id_range(0, 5)
    hit = 1 if b < v else 0
    k = id_range(0, hit)
    return b


@workflow
def early_return(v):
    if is_even(v):
        return double(v)
    else:
        w = add_one(v)
        return w


@workflow
def nested_loops(v):
    total = 0
    i = 0
    while less_than(i, v):
        j = 0
        while less_than(j, i):
            total = add(total, j)
            j = add(j, 1)
        i = add(i, 1)
    return total


@workflow
def python_loop(v):
    # the loop's body needs Python: one pass, to each row's exit
    i = 0
    while less_than(i, v):
        i = add(batch_task(i), 1)
    return i


@workflow
def concatenated(v):
    return multiple_args_task(v, "-suffix")


@workflow
def structured(v):
    return complex_return_task(v)


@workflow
def unit_result(v):
    if v > 2:
        action_if_true()


@workflow
def ordered_contexts(v):
    a = stream_task(v)
    return split(a, 2)
