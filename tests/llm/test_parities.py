"""Parities of shingle sets never rule out a pair that is similar enough."""

from __future__ import annotations

import random

import numpy as np

from ssaflow.llm import simhash


def test_parities_bound_the_difference():
    rng = np.random.default_rng(3)
    for size in (0, 1, 5, 300, 5000):
        x = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        for shared in (0.0, 0.5, 0.9, 1.0):
            y = np.unique(np.concatenate([x[: int(shared * len(x))], rng.integers(0, 1 << 63, int((1 - shared) * size)).astype(np.uint64)]))
            bits = sum(int(b).bit_count() for b in simhash.parities(x).view(np.uint64) ^ simhash.parities(y).view(np.uint64))
            assert bits <= len(np.setxor1d(x, y))


def test_open_pairs_hold_all_that_are_similar(spark):
    rng = random.Random(5)
    base = [rng.randrange(1 << 62) for _ in range(200)]
    made = [np.unique(np.array(rng.sample(base, k) + [rng.randrange(1 << 62) for _ in range(200 - k)], np.uint64)) for k in range(120, 201, 4)]
    made += [np.empty(0, np.uint64), np.empty(0, np.uint64)]
    sets = spark.createDataFrame([(i, len(h), [int(v) for v in simhash.parities(h)]) for i, h in enumerate(made)], "doc_id bigint, n int, sketch array<bigint>")
    pairs = [(a, b) for a in range(len(made)) for b in range(a)]
    similar = {(a, b) for a, b in pairs if 9 * len(np.intersect1d(made[a], made[b])) >= 4 * (len(made[a]) + len(made[b]))}
    left = {tuple(r) for r in simhash.promising(spark.createDataFrame(pairs, "a bigint, b bigint"), sets, 0.8).collect()}
    # nothing is lost, and what is far apart is ruled out
    assert similar <= left and len(left) < len(pairs) / 2


def test_one_id_with_two_texts_stays_open(spark):
    far = [" ".join(f"{c}{i}" for i in range(60)) for c in "xy"]
    near = far[0].replace("x59", "other")
    rows = [(1, far[0]), (1, far[1]), (2, near), (2, near), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.node: r.component for r in simhash.components(simhash.similar_links(docs, 0.8)).collect()}
    assert got[1] == 1 and got[2] == 1 and got[3] == 3 and got[4] == 3
