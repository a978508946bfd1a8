"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's fingerprint is the bitwise majority of the hashes of its word shingles. Each distinct fingerprint is sent to
every value within half the radius of it; two fingerprints within the radius meet at a value between them. What meets there is
deduplicated and checked against the least, which links all without making all their pairs.

Defined results: a null text counts as empty; texts without words have fingerprint zero, which links like any other;
texts with fewer words than a shingle are one shingle; repeated rows share a fingerprint; long texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ssaflow.llm.common import lean, materialise, release, word_blocks
from ssaflow.llm.components import components, with_least

#: The seed of the shingles' hash.
SEED = 42


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """The hashes of all shingles, repeats included."""
    if not text:
        return np.empty(0, np.uint64)
    digest, found, carry, n = xxhash.xxh64_intdigest, [], [], 0
    join = b" ".join
    for words in word_blocks(text.encode().lower()):
        n += len(words)
        words = carry + words
        found.append(np.array([digest(join(s), SEED) for s in zip(*(words[k:] for k in range(width)), strict=False)], np.uint64))
        carry = words[-(width - 1) :] if width > 1 else []
    if 0 < n < width:
        return np.array([digest(join(carry), SEED)], np.uint64)
    return np.concatenate(found)


_LANES = np.uint64(0x0101010101010101)


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """For each array the 64 bits that are set in over half of it; zero where it is empty."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    if not sizes.sum():
        return out
    full = np.flatnonzero(sizes)
    sizes, flat = sizes[full], np.concatenate(hashes)
    # runs of at most 255 hashes of one text, whose counts fit in a byte
    runs = -(-sizes // 255)
    text_of = np.repeat(np.arange(len(sizes)), runs)
    first_run = np.cumsum(runs) - runs
    starts = (np.cumsum(sizes) - sizes)[text_of] + 255 * (np.arange(len(text_of)) - first_run[text_of])
    bits = np.zeros(len(sizes), np.uint64)
    for k in range(8):
        lanes = np.add.reduceat((flat >> np.uint64(k)) & _LANES, starts).view(np.uint8).reshape(-1, 8)
        counts = np.add.reduceat(lanes.astype(np.int64), first_run, axis=0)
        for byte in range(8):
            bits |= (2 * counts[:, byte] > sizes).astype(np.uint64) << np.uint64(8 * byte + k)
    out[full] = bits
    return out


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number; one narrow pass."""
    kind = dict(docs.dtypes)[id_col]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fp = majority([shingle_hashes(t, width) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"doc_id {kind}, fp bigint")


def ball(radius: int) -> str:
    """SQL for all values within radius of fp."""
    masks = {0}
    for _ in range(radius):
        masks |= {m ^ (1 << b) for m in masks for b in range(64)}
    if radius == 0:
        return "array(fp)"
    if radius == 1:
        return "concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))"
    signed = sorted(m - (1 << 64) if m >> 63 else m for m in masks)
    return f"transform(array({', '.join(f'{m}L' if m > -(1 << 63) else 'shiftleft(1L, 63)' for m in signed)}), m -> fp ^ m)"


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Links a, b between distinct fingerprints (column fp) that connect just those within the radius.

    With an even radius all that meet at a value are within the radius of each other, so a star around the least
    keeps every connection; its links are verified all the same. An odd radius needs all pairs that meet: a value's
    meeting is bounded by the ball, whatever the number of documents.
    """
    at = distinct.select(F.explode(F.expr(ball((radius + 1) // 2))).alias("value"), "fp")
    # what meets: at most as many distinct fingerprints as a ball has values
    met = at.groupBy("value").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.collect_set("fp").alias("all")).where("lo < hi")
    if radius % 2 == 0:
        pairs = met.select(F.col("lo").alias("b"), F.explode("all").alias("a"))
    else:
        pairs = met.select(F.explode("all").alias("b"), "all").select("b", F.explode("all").alias("a"))
    return pairs.where(f"a <> b and bit_count(a ^ b) <= {radius}").distinct()


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fingerprint (16 hexadecimal digits) and component_id, the smallest id reachable."""
    prints = materialise(fingerprints(docs, width, id_col, text_col), "simhash")
    # one row for each distinct fingerprint, however many copies there are
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    # a small table makes many rows: it is dealt out before
    spread = classes.select("fp").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    linked = components(links(spread, radius), "simhash-links")
    rooted = classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    heads = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(heads, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- similarity of texts: prefixes of their sets of shingles ----------------------------------------------------------

#: Documents, about, that tell which shingles are frequent, and the shingles that are known as frequent at most.
ORDER_DOCS, ORDER_SHINGLES = 20_000, 200_000
#: Sets of shingles that a worker remembers.
KNOWN_SETS = 256

#: Bits of the parities of a set of shingles, a power of two; and the 64-bit numbers that go along where all that share a
#: shingle meet.
SKETCH_BITS, FOLDED = 1024, 4

#: Rounds in which what shares a shingle is paired with one other by chance, before all that is still apart is paired.
CHANCE_ROUNDS = 3
#: Pairs of a node that are compared in the first round of all that are left, and how many times more in each next one.
ROUND_PAIRS, ROUND_GROWTH = 32, 32


def frequent(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of shingles that several of a bounded sample of documents have, ascending, and the rank of each, the
    rarest first. docs: doc_id, text.

    They only order shingles: any order that all documents share finds every pair, a good one meets fewer others.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            hashes = [np.unique(shingle_hashes(t, width)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *hashes]).view(np.int64))], ["h"])

    share = min(1.0, ORDER_DOCS / max(1, docs.count()))
    sample = docs.where(F.pmod(F.xxhash64(F.lit(13), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * share)).select("text")
    counts = sample.mapInArrow(lean(run), "h bigint").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    rows = counts.orderBy(F.desc("n"), "h").limit(ORDER_SHINGLES).toArrow()
    hashes, n = rows.column("h").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order, ranks = np.argsort(hashes), np.empty(len(n), np.int64)
    ranks[np.lexsort((hashes, n))] = np.arange(len(n))
    return hashes[order], ranks[order]


def prefix(hashes: np.ndarray, known: np.ndarray, ranks: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set in the shared order, the rare ones before the known: so many that any set of the
    similarity has one of them among its own first ones."""
    n = len(hashes)
    size = n - math.ceil(similarity * n - 1e-9) + 1 if n else 0
    if not len(known):
        return hashes[:size]
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    common = known[at] == hashes
    return np.concatenate([hashes[~common], hashes[common][np.argsort(ranks[at[common]])]])[:size]


def parities(hashes: np.ndarray) -> np.ndarray:
    """For each residue of the set's hashes modulo SKETCH_BITS whether an odd number of them has it, as 64-bit numbers.
    Two sets differ in at least as many members as their parities in bits."""
    odd = np.bincount((hashes & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def differ_less(x: str, y: str, similarity: float) -> str:
    """SQL: whether sets of sizes n and m with parities x and y may be as similar; false only where they aren't."""
    bits = f"aggregate(zip_with({x}, {y}, (p, q) -> bit_count(p ^ q)), 0, (t, c) -> t + c)"
    return f"{bits} <= (1 - {similarity!r}D) / (1 + {similarity!r}D) * (n + m) + 1e-9D"


def shingle_rows(docs: DataFrame, similarity: float, width: int) -> DataFrame:
    """doc_id, d0 and d1 (a digest of the set of shingles), n (its size), sketch (its parities) and first (its prefix);
    one narrow pass."""
    known, ranks = frequent(docs, width)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sets = [np.unique(shingle_hashes(t, width)) for t in batch.column(1).to_pylist()]
            digests = np.array([np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64) for h in sets]).reshape(-1, 2)
            first = [prefix(h, known, ranks, similarity).view(np.int64) for h in sets]
            sketch = [parities(h) for h in sets]
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (sketch, first)]
            cols = [pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array([len(h) for h in sets], pa.int32()), *lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "d0", "d1", "n", "sketch", "first"])

    return docs.mapInArrow(lean(run), "doc_id bigint, d0 bigint, d1 bigint, n int, sketch array<bigint>, first array<bigint>")


def can_be(similarity: float) -> str:
    """SQL: whether two sets of sizes n and m, with a common shingle at places i and j in the order, can be as similar."""
    least = f"{similarity!r}D / (1 + {similarity!r}D) * (n + m) - 1e-9D"
    return f"least(n, m) >= {similarity!r}D * greatest(n, m) - 1e-9D and least(i, j) + 1 + least(n - i - 1, m - j - 1) >= {least}"


def promising(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b of ids without those whose parities show that they aren't as similar. sets: doc_id, n, sketch."""
    left = sets.select(F.col("doc_id").alias("a"), "n", F.col("sketch").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y"))
    return pairs.join(left, "a").join(right, "b").where(differ_less("x", "y", similarity)).select("a", "b").distinct()


def alike(pairs: DataFrame, docs: DataFrame, sets: DataFrame, similarity: float, width: int) -> DataFrame:
    """Of pairs a, b of ids those whose texts' sets of shingles have at least this Jaccard similarity. docs: doc_id, text;
    sets: doc_id, n, sketch of each text."""
    wanted = pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select("b")).distinct()
    # texts are long: they go only where the parities leave the pair open
    pairs = materialise(promising(pairs, materialise(sets.join(wanted, "doc_id", "left_semi").distinct(), "similar-sets"), similarity), "similar-open")
    wanted = pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select("b")).distinct()
    texts = materialise(docs.join(wanted, "doc_id", "left_semi").distinct(), "similar-texts")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}

        def of(text: str | None) -> np.ndarray:
            if text not in known:
                if len(known) >= KNOWN_SETS:
                    known.clear()
                known[text] = np.unique(shingle_hashes(text, width))
            return known[text]

        for batch in it:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                m, n = of(x), of(y)
                both = len(np.intersect1d(m, n, assume_unique=True))
                good.append(both >= similarity * (len(m) + len(n) - both) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    left, right = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("at")), texts.select(F.col("doc_id").alias("b"), F.col("text").alias("bt"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "at", "bt").mapInArrow(lean(run), "a bigint, b bigint").distinct()


def apart(met: DataFrame, of: DataFrame) -> DataFrame:
    """What shares a shingle with nodes of other components. met: key, node, n, i; of: node, component."""
    named = met.join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    return materialise(named.join(mixed, "key", "left_semi"), "shared-apart")


def by_chance(named: DataFrame, similarity: float, seed: int) -> DataFrame:
    """Pairs a, b of nodes apart that follow each other among those of a shingle, in an order of its own: linear in the
    rows, and what many shingles share meets many others."""
    order = Window.partitionBy("key").orderBy(F.xxhash64(F.lit(seed), "key", "node"), "node")
    pairs = named.select("node", "n", "i", "component", F.lag(F.struct("node", "n", "i", "component")).over(order).alias("other"))
    pairs = pairs.where("component <> other.component").select(F.col("node").alias("a"), F.col("other.node").alias("b"), "n", "i", F.col("other.n").alias("m"), F.col("other.i").alias("j"))
    return pairs.where(can_be(similarity)).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def unconnected(named: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs a, b of nodes apart that share shingles and can be as similar by these and by their parities."""
    # parities modulo a divisor are sums of parities; sets of one id that differ stay open
    width = SKETCH_BITS // 64
    folded = F.expr(f"transform(sequence(0, {FOLDED - 1}), k -> aggregate(sequence(k, {width - 1}, {FOLDED}), 0L, (t, i) -> t ^ element_at(sketch, i + 1)))")
    one = sets.groupBy("doc_id").agg(F.min("sketch").alias("sketch"), F.max("sketch").alias("last")).select(F.col("doc_id").alias("node"), F.when(F.expr("sketch = last"), folded).alias("x"))
    named = named.join(one, "node")
    other = named.select("key", F.col("node").alias("b"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("component").alias("far"), F.col("x").alias("y"))
    pairs = named.withColumnRenamed("node", "a").join(other, "key").where("a > b and component <> far").where(can_be(similarity))
    pairs = pairs.where(f"x is null or y is null or {differ_less('x', 'y', similarity)}")
    # what is common beyond the prefix that ends first is in the rest of that set
    rest = f"greatest(ceil({similarity!r}D * n - 1e-9D), ceil({similarity!r}D * m - 1e-9D)) - 1"
    counted = pairs.groupBy("a", "b", "n", "m").agg(F.count("*").alias("shared"))
    return counted.where(f"shared + {rest} >= {similarity!r}D / (1 + {similarity!r}D) * (n + m) - 1e-9D").select("a", "b").distinct()


def in_rounds(todo: DataFrame, linked: DataFrame, docs: DataFrame, sets: DataFrame, similarity: float, width: int) -> DataFrame:
    """Links that connect what linked and the links among the pairs a, b of todo do: some pairs of each node are compared, what these connect needs
    no more, and so on, until each pair has been decided or connected."""
    many = ROUND_PAIRS
    while not todo.isEmpty():
        ranked = todo.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("a", "b"), "b")))
        ranked = materialise(ranked, "similar-ranked")
        linked = materialise(linked.unionByName(alike(ranked.where(F.col("rank") <= many).select("a", "b"), docs, sets, similarity, width)), "similar-links")
        left = ranked.where(F.col("rank") > many).select("a", "b")
        if left.isEmpty():
            break
        of = components(linked, "similar-linked")
        linked = of.select(F.col("node").alias("a"), F.col("component").alias("b"))
        left = left.join(of.withColumnRenamed("node", "a").withColumnRenamed("component", "near"), "a", "left").join(of.withColumnRenamed("node", "b").withColumnRenamed("component", "far"), "b", "left")
        todo = materialise(left.where(F.coalesce("near", "a") != F.coalesce("far", "b")).select("a", "b"), "similar-rest")
        many *= ROUND_GROWTH
    return linked


def similar_links(docs: DataFrame, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text", linked: DataFrame | None = None) -> DataFrame:
    """Links a, b between ids of documents that connect copies, and classes whose texts' sets of shingles have at least the
    Jaccard similarity. What is linked already is given along and needn't be compared.

    Sets as similar share a shingle of their prefixes. What shares one is first paired with the least and the one before,
    then with others by chance; last all that share one and aren't connected yet are paired, so that each pair is decided
    or connected.
    """
    docs = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialise(shingle_rows(docs, similarity, width), "shingles")
    sets = rows.select("doc_id", "n", "sketch")
    # equal sets of shingles have equal prefixes
    classes = with_least(rows.select("doc_id", "d0", "d1"), ["d0", "d1"], "doc_id")
    classes = materialise(classes.select("doc_id", "d0", "d1", F.col("m").alias("node")).distinct(), "shingle-classes")
    copies = classes.where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    linked = copies if linked is None else copies.unionByName(linked)
    release(docs.sparkSession)
    # one text of each class goes on
    chosen = rows.join(classes.where("doc_id = node").select("doc_id", "d0", "d1"), ["doc_id", "d0", "d1"], "left_semi").dropDuplicates(["doc_id", "d0", "d1"])
    posted = chosen.select(F.col("doc_id").alias("node"), "n", F.posexplode("first").alias("i", "key"))
    order = Window.partitionBy("key").orderBy("n", "node")
    this = F.struct("node", "n", "i")
    met = posted.select("key", "node", "n", "i", F.lag(this).over(order).alias("before"), F.first(this).over(order).alias("least"), F.lead("node").over(order).alias("after"))
    # only what shares a shingle is kept
    met = materialise(met.where("before is not null or after is not null").drop("after"), "shared-shingles")
    release(docs.sparkSession)
    other = F.explode(F.array("before", "least")).alias("other")
    near = met.where("before is not null").select("node", "n", "i", other).select(F.col("node").alias("a"), F.col("other.node").alias("b"), "n", "i", F.col("other.n").alias("m"), F.col("other.i").alias("j"))
    pairs = near.where(F.col("a") != F.col("b")).where(can_be(similarity)).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    tried = materialise(pairs, "similar-pairs")
    linked = materialise(linked.unionByName(alike(tried, docs, sets, similarity, width)), "similar-links")
    met = met.select("key", "node", "n", "i")
    for seed in range(CHANCE_ROUNDS):
        release(docs.sparkSession)
        # what is linked goes on as a star around each component's least
        of = components(linked, "similar-linked")
        linked = of.select(F.col("node").alias("a"), F.col("component").alias("b"))
        met = apart(met, of).select("key", "node", "n", "i", "component")
        pairs = materialise(by_chance(met, similarity, seed).join(tried, ["a", "b"], "left_anti"), "similar-pairs")
        if pairs.isEmpty():
            break
        linked = materialise(linked.unionByName(alike(pairs, docs, sets, similarity, width)), "similar-links")
        tried, met = tried.unionByName(pairs), met.drop("component")
    release(docs.sparkSession)
    of = components(linked, "similar-linked")
    linked = of.select(F.col("node").alias("a"), F.col("component").alias("b"))
    met = apart(met.select("key", "node", "n", "i"), of)
    rest = materialise(unconnected(met, sets, similarity).join(tried, ["a", "b"], "left_anti"), "similar-rest")
    release(docs.sparkSession)
    return in_rounds(rest, linked, docs, sets, similarity, width)


def fingerprint_links(docs: DataFrame, width: int, radius: int, id_col: str, text_col: str) -> DataFrame:
    """Links a, b between ids of documents that connect the groups of near_duplicates."""
    prints = fingerprints(docs.where(F.col(id_col).isNotNull()), width, id_col, text_col).select(F.col("doc_id").cast("bigint").alias("doc_id"), "fp")
    named = materialise(with_least(prints, ["fp"], "doc_id").select("doc_id", "fp", "m").distinct(), "simhash")
    least = named.where("doc_id = m").select("fp", "m")
    spread = least.select("fp").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    near = links(spread, radius).join(least.select(F.col("fp").alias("a"), F.col("m").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("m").alias("y")), "b")
    return materialise(named.where("doc_id <> m").select(F.col("doc_id").alias("a"), F.col("m").alias("b")).unionByName(near.select(F.col("x").alias("a"), F.col("y").alias("b"))), "simhash-links")


def keep_one(docs: DataFrame, width: int = 3, radius: int = 2, similarity: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, without near-duplicates: of each group the one with the smallest id stays.

    Groups are those of near_duplicates; a similarity adds links between texts whose sets of five-word shingles are as
    similar. Rows without an id can't be named and stay; of rows that repeat an id one stays.
    """
    if similarity is None:
        groups = near_duplicates(docs, width, radius, id_col, text_col).select(F.col(id_col).alias("doc"), "component_id")
        heads = groups.where("doc = component_id").select(F.col("doc").alias("_head")).distinct()
        named = docs.join(heads, docs[id_col] == heads["_head"], "left_semi")
    else:
        linked = fingerprint_links(docs, width, radius, id_col, text_col)
        release(docs.sparkSession)
        merged = components(similar_links(docs, similarity, 5, id_col, text_col, linked), "near-duplicates")
        gone = merged.where("node <> component").select(F.col("node").alias("_gone"))
        named = docs.where(F.col(id_col).isNotNull()).join(gone, docs[id_col] == gone["_gone"], "left_anti")
    return named.dropDuplicates([id_col]).unionByName(docs.where(F.col(id_col).isNull()))
