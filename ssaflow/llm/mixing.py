"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: the sources share a multiple of all sizes by weight; none gets more than a multiple of its own size, and what
is over goes to the others by weight. A source first gives as many complete epochs as its target holds. The rest is
drawn without replacement: each document's key is an exponential variate divided by its quality weight, documents go
in the order of their keys, and a prefix sum of sizes stops at the rest of the budget; the document at the boundary is
taken as far as the budget goes.

Keys are cut into ranges of bounded numbers of documents; sizes are summed by range first, so only the range that
holds a source's boundary is sorted, and no source meets in one task however large it is.

Defined results: a null text has size 0; a null source is a source of its own, ordered last; documents of size 0 take
0; equal keys go by id, then by text; repeated rows count as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ssaflow.llm.common import WORD_RE, materialise

#: Weights of the sources in their order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Documents that a range of keys holds, about.
RANGE_DOCS = 2_000
#: Sources up to so many are broadcast, a row of some hundred bytes each; more are joined by shuffle.
BROADCAST_SOURCES = 100_000
#: Sources at most, as the driver holds a row for each: more raise an error.
MOST_SOURCES = 1_000_000
#: A source's ranges at most; ranges just grow beyond.
MOST_RANGES = 1 << 20


def share_out(sizes: Sequence[int], weights: Sequence[float], total: float, cap: float) -> list[float]:
    """Each source's part of total by weight, at most cap times its size; the excess is shared again by weight."""
    targets = [0.0] * len(sizes)
    # those with the least room for their weight are over first; sums are exact, whatever the order
    order = sorted(range(len(sizes)), key=lambda i: cap * sizes[i] / weights[i])
    left, weight = Fraction(total), sum(map(Fraction, weights[: len(sizes)]), Fraction(0))
    for n, i in enumerate(order):
        if weights[i] * float(left) / float(weight) <= cap * sizes[i]:
            for k in order[n:]:
                targets[k] = weights[k] * float(left) / float(weight)
            break
        targets[i] = cap * sizes[i]
        left, weight = left - Fraction(targets[i]), weight - Fraction(weights[i])
    return targets


def quality(text: Column) -> Column:
    """A weight from 0.5 to 2: the share of words that are plain, letters with at most one mark after them."""
    words = F.regexp_count(text, F.lit(WORD_RE))
    plain = F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])\p{L}++[,.;:!?]?(?![^\x20\x09-\x0D])"))
    return F.when(words > 0, 0.5 + 1.5 * plain / words).otherwise(0.5)


def uniform(seed: int, *parts: Column) -> Column:
    """A number above 0 and at most 1 from a digest of the parts; reruns, and other engines, give the same."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *parts).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + 1) / F.lit(float(1 << 52))


def _by_source(rows: DataFrame, other: DataFrame, small: bool) -> DataFrame:
    """Join with a row for each source; the null source is one too."""
    other = other.withColumnRenamed("source", "_source")
    other = F.broadcast(other) if small else other
    return rows.join(other, rows["source"].eqNullSafe(other["_source"])).drop("_source")


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: Sequence[float] = WEIGHTS, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: Sequence[Column] = ()) -> DataFrame:
    """One row per document: id, size, source_size, target (both of its source) and taken, the words the mix takes.

    What keep has goes along as _keep0, _keep1, ..., without a shuffle but for the ranges at the budgets' ends.
    """
    kept = [f"_keep{k}" for k in range(len(keep))]
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD_RE)).cast("bigint").alias("size"),
        (-F.log(uniform(seed, F.coalesce(F.col(id_col).cast("string"), F.lit("")), text)) / quality(text)).alias("key"), F.xxhash64(text).alias("tie"),
        *(c.alias(n) for c, n in zip(keep, kept, strict=True)),
    )
    sized = materialise(sized, "mixing")
    # one row for each source comes to the driver, a bounded number
    totals = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    totals.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r["size"] for r in totals]
    targets = share_out(sizes, [weights[i % len(weights)] for i in range(len(totals))], share * sum(sizes), cap)
    plan = []
    for r, t in zip(totals, targets, strict=True):
        epochs = int(t // r["size"]) if r["size"] else 0
        plan.append((r.source, r["size"], t, epochs, int(t - epochs * r["size"] + 0.5), min(MOST_RANGES, r.n // RANGE_DOCS + 1)))
    sources = docs.sparkSession.createDataFrame(plan, "source string, source_size bigint, target double, epochs bigint, budget bigint, ranges bigint")
    small = len(plan) <= BROADCAST_SOURCES
    # an exponential key's distribution function spreads the keys over the ranges, in order
    rows = _by_source(sized, sources.select("source", "budget", "ranges"), small).withColumn("range", F.floor((1 - F.exp(-F.col("key"))) * F.col("ranges")))
    sums = rows.groupBy("source", "range", "budget").agg(F.sum("size").alias("in_range"))
    until = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("in_range").over(until), F.lit(0)))
    # the first range that its source's budget doesn't cover whole; all earlier ones are taken
    edge = F.min(F.when(F.col("before") + F.col("in_range") > F.col("budget"), F.struct("range", "before")))
    marks = sums.groupBy("source").agg(edge.alias("edge"))
    marked = _by_source(sources, marks, small).select("source", "source_size", "target", "epochs", "budget", "ranges", F.col("edge.range").alias("edge"), "edge.before")
    rows = _by_source(sized, marked, small).withColumn("range", F.floor((1 - F.exp(-F.col("key"))) * F.col("ranges")))
    inside = rows.where("edge is null or range <> edge").withColumn("extra", F.when(F.expr("edge is null or range < edge"), F.col("size")).otherwise(0))
    ahead = Window.partitionBy("source").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    at_edge = rows.where("range = edge").withColumn("left", F.col("budget") - F.col("before") - F.coalesce(F.sum("size").over(ahead), F.lit(0)))
    at_edge = at_edge.withColumn("extra", F.greatest(F.lit(0), F.least("size", "left"))).drop("left")
    taken = (F.col("epochs") * F.col("size") + F.col("extra")).cast("bigint").alias("taken")
    return inside.unionByName(at_edge).select(F.col("doc_id").alias(id_col), "size", "source_size", "target", taken, *kept)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself, in the columns of docs: each document once for each whole time that it is taken, and where a
    budget ends inside one, its first words joined by spaces."""
    names = docs.columns
    taken = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, keep=[F.col(f"`{c}`") for c in names], **how)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    rest = (F.col("taken") - whole * F.col("size")).cast("int")
    # the number of words of each copy
    copies = F.concat(F.array_repeat(F.col("size").cast("int"), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    out = taken.select("*", F.explode(copies).alias("_words"))
    text = F.col(f"_keep{names.index(text_col)}")
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD_RE), F.lit(0)), 1, F.col("_words")), " ")
    shown = F.when(F.col("_words") < F.col("size"), cut).otherwise(text)
    return out.select(*(shown.alias(c) if c == text_col else F.col(f"_keep{k}").alias(c) for k, c in enumerate(names)))
