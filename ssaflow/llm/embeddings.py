"""Embedding near-duplicates by dual traversal of cover trees.

Equal vectors are one class. The upper tree's nodes are pivots from a bounded sample: nested levels, each with half the
radius of the one above, every pivot covered by one of the level above. A class belongs to its nearest leaf pivot; a
leaf's classes are stored in blocks of bounded size in the shared folder, each with a lower tree of its own. Pairs of
nodes whose balls are further apart than the threshold are pruned, pairs whose balls lie within it link as a whole, and
what is left is compared in double precision. A pair of blocks gives back counts and a spanning forest of its links,
never the links themselves, so a large group of near copies costs as many rows as it has members.

Distances are those of unit vectors; a cosine of c is a distance of sqrt(2 - 2c). Vectors without structure (all
directions alike, many dimensions) leave little to prune: every pair of blocks is then compared.

Defined results: vectors that are null, empty, zero, or have null or non-finite components link with nothing; shorter
vectors compare as if filled up with zeros; ties don't matter, the threshold is included; repeated rows each count; rows of one
id with different vectors are vectors of their own; a row without an id links and counts like any other, its
component_id is null and it is kept.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ssaflow.llm.common import materialise, read_file, shared_dir, write_file
from ssaflow.llm.components import components

#: Classes in a block, about, and pivots at most.
BLOCK_ROWS, MOST_PIVOTS = 2048, 512
#: A node of so few classes isn't divided further.
LEAF_ROWS = 48
#: Room for rounding in bounds; comparisons themselves have none.
SLACK = 1e-9


def unit(rows: list, dims: int) -> np.ndarray:
    """Vectors as rows of length 1, in double precision."""
    out = np.zeros((len(rows), dims))
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    # a power of two first, so that squares neither overflow nor vanish
    out /= np.exp2(np.floor(np.log2(np.abs(out).max(axis=1, keepdims=True))))
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


class Tree:
    """A cover tree over unit vectors x: points in node order, and per node its range, parent's place, center and radius."""

    def __init__(self, x: np.ndarray, least: float) -> None:
        self.order = np.arange(len(x))
        self.nodes: list[tuple[int, int, int, float]] = []
        self.children: list[list[int]] = []
        self._grow(x, 0, len(x), 2.0, least)

    def _grow(self, x: np.ndarray, lo: int, hi: int, radius: float, least: float) -> int:
        """Make the node of order[lo:hi], covered by radius around its first point; its number."""
        mine = self.order[lo:hi].copy()
        far = float(distances(x[mine[:1]], x[mine]).max()) if len(mine) else 0.0
        me = len(self.nodes)
        self.nodes.append((lo, hi, int(mine[0]) if len(mine) else 0, far))
        self.children.append([])
        half = min(radius, 2 * far) / 2
        while hi - lo > LEAF_ROWS and half >= least:
            groups = self._cover(x, mine, half)
            if groups is None:
                break  # hardly any two points are that near: smaller balls would be as many as points
            if len(groups) == 1:
                half /= 2
                continue
            at = lo
            for g in groups:
                self.order[at : at + len(g)] = g
                at += len(g)
            at = lo
            for g in groups:
                self.children[me].append(self._grow(x, at, at + len(g), half, least))
                at += len(g)
            break
        return me

    @staticmethod
    def _cover(x: np.ndarray, points: np.ndarray, radius: float) -> list[np.ndarray] | None:
        """Balls of the radius around points that no earlier ball holds; None if they are too many to help."""
        left, groups = points, []
        while len(left):
            near = distances(x[left[:1]], x[left])[0] <= radius
            near[0] = True
            groups.append(left[near])
            left = left[~near]
            if len(groups) > max(16, len(points) // 8):
                return None
        return groups


def build_block(x: np.ndarray, ids: np.ndarray, counts: np.ndarray, least: float) -> bytes:
    tree = Tree(x, least)
    nodes = np.array(tree.nodes, np.float64).reshape(-1, 4)
    starts = np.cumsum([0, *map(len, tree.children)])
    out = io.BytesIO()
    centers = x[nodes[:, 2].astype(np.int64)]
    np.savez(out, x=x[tree.order], ids=ids[tree.order], counts=counts[tree.order], lo=nodes[:, 0].astype(np.int64), hi=nodes[:, 1].astype(np.int64), radius=nodes[:, 3], centers=centers, starts=starts, children=np.array([c for cs in tree.children for c in cs], np.int64))
    return out.getvalue()


class Forest:
    """Disjoint sets over numbered points, joined many pairs at a time."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        r = self.parent[at]
        while not np.array_equal(up := self.parent[r], r):
            r = up
        self.parent[at] = r
        return r

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))


def compare(p, q, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """For each point of two blocks the vectors of the other that it links with, and links that connect all linked."""
    eps = math.sqrt(2.0 - 2.0 * threshold)
    n = len(p["ids"])
    sums_p, sums_q = np.zeros(n, np.int64), np.zeros(len(q["ids"]), np.int64)
    forest = Forest(n if same else n + len(q["ids"]))
    shift = 0 if same else n
    # the arrays are read once: each access to an archive member reads it again
    px, qx, pc, qc = p["x"], q["x"], p["counts"], q["counts"]
    gap = distances(p["centers"], q["centers"])
    stack = [(0, 0)] if n and len(q["ids"]) else []
    kids = lambda t, k: t["children"][t["starts"][k] : t["starts"][k + 1]]
    while stack:
        a, b = stack.pop()
        ra, rb, d = p["radius"][a], q["radius"][b], gap[a, b]
        if d - ra - rb > eps + SLACK:
            continue
        ka, kb = kids(p, a), kids(q, b)
        la, ha, lb, hb = p["lo"][a], p["hi"][a], q["lo"][b], q["hi"][b]
        if d + ra + rb < eps - SLACK:
            sums_p[la:ha] += qc[lb:hb].sum()
            if not (same and a == b):
                sums_q[lb:hb] += pc[la:ha].sum()
            forest.join(np.full(hb - lb, la), np.arange(lb, hb) + shift)
            forest.join(np.arange(la, ha), np.full(ha - la, lb + shift))
        elif same and a == b and len(ka):
            stack += [(i, j) for k, i in enumerate(ka) for j in ka[k:]]
        elif len(ka) and (ra >= rb or not len(kb)):
            stack += [(i, b) for i in ka]
        elif len(kb):
            stack += [(a, j) for j in kb]
        else:
            for at in range(la, ha, 512):
                to = min(ha, at + 512)
                hit = px[at:to] @ qx[lb:hb].T >= threshold
                if hit.any():
                    sums_p[at:to] += hit @ qc[lb:hb]
                    if not (same and a == b):
                        sums_q[lb:hb] += pc[at:to] @ hit
                    i, j = np.nonzero(hit)
                    forest.join(i + at, j + lb + shift)
    ids = p["ids"] if same else np.concatenate([p["ids"], q["ids"]])
    tied = np.flatnonzero(forest.parent != np.arange(len(forest.parent)))
    roots = forest.roots(tied)
    return sums_p, sums_q, list(zip(ids[tied].tolist(), ids[roots].tolist(), strict=True))


def upper_tree(sample: np.ndarray, least: float) -> tuple[np.ndarray, list[list[int]]]:
    """Pivots in the order of nested levels with halving radii, and each leaf's path of ancestors by level."""
    radius, centers = 2.0, [0]
    paths: list[list[int]] = [[0]] * len(sample)
    while len(centers) < len(sample) and radius / 2 >= least:
        radius /= 2
        gap = distances(sample[centers], sample)
        nearest = gap.min(axis=0)
        for k in range(len(sample)):
            if nearest[k] > radius:
                centers.append(k)
                nearest = np.minimum(nearest, distances(sample[[k]], sample)[0])
        level = np.array(centers)
        holder = level[distances(sample[level], sample).argmin(axis=0)]
        paths = [[*path, int(h)] for path, h in zip(paths, holder, strict=True)]
    leaves = np.array(centers)
    return leaves, [paths[k] for k in leaves]


def leaf_pairs(pivots: np.ndarray, paths: list[list[int]], sample: np.ndarray, radii: np.ndarray, eps: float) -> list[tuple[int, int]]:
    """Dual traversal of the upper tree: pairs of leaves that may hold a link."""
    depth = len(paths[0])
    members: list[dict[int, list[int]]] = [{} for _ in range(depth)]
    for leaf, path in enumerate(paths):
        for level, node in enumerate(path):
            members[level].setdefault(node, []).append(leaf)
    gap = distances(pivots, sample)

    def ball(level: int, node: int) -> float:
        return max(gap[k, node] + radii[k] for k in members[level][node])

    balls = [{node: ball(level, node) for node in m} for level, m in enumerate(members)]
    found, stack = [], [(0, a, b) for a in members[0] for b in members[0] if a <= b]
    while stack:
        level, a, b = stack.pop()
        if float(distances(sample[[a]], sample[[b]])[0, 0]) - balls[level][a] - balls[level][b] > eps + SLACK:
            continue
        if level + 1 < depth:
            below = lambda node: {paths[k][level + 1] for k in members[level][node]}  # noqa: B023, E731
            stack += [(level + 1, min(i, j), max(i, j)) for i, j in {(min(i, j), max(i, j)) for i in below(a) for j in below(b)}]
            continue
        for i in members[level][a]:
            for j in members[level][b]:
                if i <= j or a != b:
                    d = float(distances(pivots[[i]], pivots[[j]])[0, 0])
                    if d - radii[i] - radii[j] <= eps + SLACK:
                        found.append((min(i, j), max(i, j)))
    return sorted(set(found))


def _valid(e):
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return e.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(e, lambda x: x != 0)


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: id, n_links, component_id and kept."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"))
    # ids may repeat or be missing: classes of equal vectors have numbers of their own, which the written table fixes
    grouped = rows.where(_valid(F.col("v"))).groupBy("v").agg(F.min("vec_id").cast("bigint").alias("least"), F.count("*").alias("n"))
    classes = materialise(grouped.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    shape = classes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims")).first()
    links, edges = _links(spark, classes, shape["n"], shape.dims, threshold) if shape["n"] else (spark.createDataFrame([], "rep bigint, links bigint"), spark.createDataFrame([], "a bigint, b bigint"))
    roots = components(edges, "vector-links").withColumnRenamed("node", "rep")
    rooted = classes.join(links, "rep", "left").join(roots, "rep", "left")
    rooted = rooted.select("v", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("root"))
    found = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("v", "n_links", "component_id")
    out = rows.join(found, "v", "left").withColumn("component_id", F.when(F.col("component_id").isNull() | F.col("vec_id").isNull(), F.col("vec_id")).otherwise(F.col("component_id")))
    return out.select(F.col("vec_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _links(spark, classes: DataFrame, n: int, dims: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """rep and links, the vectors of other classes linked directly; and links a, b that connect all linked classes."""
    eps = math.sqrt(2.0 - 2.0 * threshold)
    least = eps / 8
    wanted = min(MOST_PIVOTS, n // BLOCK_ROWS + 1)
    # a bounded sample, by hash: it shapes the tree, every vector is in it
    share = min(1.0, 2.0 * wanted / n)
    picked = classes.where(F.pmod(F.xxhash64(F.lit(3), "rep"), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy("rep").limit(wanted).select("v").collect()
    sample = unit([r.v for r in picked], dims) if picked else unit([classes.select("v").first().v], dims)
    leaves, paths = upper_tree(sample, least)
    pivots = sample[leaves]

    def assign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = unit(batch.column(2).to_pylist(), dims)
            if len(x):
                gap = distances(x, pivots)
                cell = gap.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(cell.astype(np.int32)), pa.array(gap[np.arange(len(x)), cell])], ["rep", "n", "x", "cell", "gap"])

    placed = materialise(classes.select("rep", "n", "v").mapInArrow(assign, "rep bigint, n bigint, x binary, cell int, gap double"), "vector-cells")
    # one row for each pivot
    cells = {r.cell: r for r in placed.groupBy("cell").agg(F.max("gap").alias("radius"), F.count("*").alias("n")).collect()}
    radii = np.array([cells[k].radius if k in cells else -math.inf for k in range(len(pivots))])
    chunks = spark.createDataFrame([(k, r["n"] // BLOCK_ROWS + 1) for k, r in cells.items()], "cell int, chunks bigint")
    folder = shared_dir(spark, "vector-blocks")

    def store(table: pa.Table) -> pa.Table:
        # in one order, so that an attempt again writes the same
        table = table.sort_by("rep")
        ids, counts = (np.array(table.column(c).to_pylist(), np.int64) for c in ("rep", "n"))
        x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.float64).reshape(len(ids), dims)
        cell, chunk = table.column("cell")[0].as_py(), table.column("chunk")[0].as_py()
        name = f"block-{cell}-{chunk}.npz"
        write_file(folder, name, build_block(x, ids, counts, least))
        return pa.table({"cell": pa.array([cell], pa.int32()), "name": [name]})

    dealt = placed.join(F.broadcast(chunks), "cell").withColumn("chunk", F.pmod(F.xxhash64(F.lit(5), "rep"), F.col("chunks")))
    blocks = materialise(dealt.select("rep", "n", "x", "cell", "chunk").groupBy("cell", "chunk").applyInArrow(store, "cell int, name string"), "vector-block-names")
    pairs = spark.createDataFrame([p for p in leaf_pairs(pivots, paths, sample, radii, eps) if p[0] in cells and p[1] in cells], "ca int, cb int")
    tasks = pairs.join(blocks.select(F.col("cell").alias("ca"), F.col("name").alias("a")), "ca").join(blocks.select(F.col("cell").alias("cb"), F.col("name").alias("b")), "cb")
    tasks = tasks.where("ca < cb or a <= b").select("a", "b")

    def load(name: str) -> dict:
        with np.load(io.BytesIO(read_file(folder, name))) as z:
            return {k: z[k] for k in z.files}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict] = {}
        for batch in it:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                # the left block stays for the pairs that follow
                held = {k: v for k, v in held.items() if k in (a, b)}
                p = held.get(a) or load(a)
                q = p if a == b else held.get(b) or load(b)
                held[a] = p
                sums_p, sums_q, edges = compare(p, q, threshold, a == b)
                if a == b:
                    sums_p = sums_p + sums_q - p["counts"]  # without itself
                    sums_q = np.zeros(0, np.int64)
                ids = np.concatenate([p["ids"], q["ids"][: len(sums_q)]])
                sums = np.concatenate([sums_p, sums_q])
                some = np.flatnonzero(sums)
                u = np.concatenate([ids[some], np.array([e[0] for e in edges], np.int64)])
                v = np.concatenate([sums[some], np.array([e[1] for e in edges], np.int64)])
                kind = np.repeat(np.array([0, 1], np.int32), [len(some), len(edges)])
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(u), pa.array(v)], ["kind", "u", "v"])

    found = materialise(tasks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "a", "b").sortWithinPartitions("a", "b").mapInArrow(run, "kind int, u bigint, v bigint"), "vector-pairs")
    links = found.where("kind = 0").groupBy(F.col("u").alias("rep")).agg(F.sum("v").alias("links"))
    return links, found.where("kind = 1").select(F.col("u").alias("a"), F.col("v").alias("b"))
