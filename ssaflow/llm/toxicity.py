"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

Terms are lower-case words and word beginnings; every term of the examples counts. A term weighs by its frequency in the
text, its rarity among all documents and its dependence on the label in a bounded sample of labelled rows; none weighs
nothing. The index keeps each term's greatest weight in each block of examples: a search takes blocks by their upper
bounds and stops when no block left can hold a nearer example, so the nearest are exact. Votes weigh by distance, and the
sample's own votes, each without its equals, calibrate them (isotonic).

Defined results: a null or empty text has no term and gets the calibrated score of such texts; labels that are null are
ignored, and a document labelled more than once counts by its greatest label; without labels of both kinds every score
is the share of the label 1 (0 if there are none); equal texts have equal scores; texts are read whole.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ssaflow.llm.common import lean, materialise, pack, unpack

#: Labelled rows of each label that the fit samples, about: they tell what terms depend on the label, and calibrate.
SAMPLE_ROWS = 5_000
#: Sampled rows of each label that become examples, and the terms that all examples have together, at most: the bound of what is broadcast.
EXAMPLES, EXAMPLE_TERMS = 400, 2_000_000
#: What a term weighs, as a factor, without any dependence on the label.
LEAST_FACTOR = 0.01
#: Lengths of the word beginnings that are terms.
BEGINNINGS = (4, 5, 6)
#: Examples in a block of the index.
BLOCK = 32
#: Terms that this part of the examples have (one in so many) have full rows in the index, so many at most.
FULL_SHARE, FULL_TERMS = 16, 1_024
#: Blocks that are searched first.
FIRST_BLOCKS = 3
#: Examples that vote.
NEIGHBOURS = 15
#: Characters whose terms are counted at a time.
COUNT_CHARS = 1 << 22

#: What separates words.
NO_LETTERS = r"[^\pL]+"
_SPACE = re.compile(r"\s")


def letters(texts: pa.Array) -> pa.Array:
    """The words of each text: its runs of letters, lists."""
    return pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.replace_substring_regex(texts, NO_LETTERS, " ")))


def terms_of(words: Sequence[str]) -> list[str]:
    """The terms of distinct lower-case words."""
    return list(dict.fromkeys([*words, *(f"{w[:n]}*" for n in BEGINNINGS for w in words if len(w) >= n)]))


def pieces(texts: Sequence[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """The lower-case texts with their places, some at a time; long ones in several pieces, cut at white space."""
    places, held, size = [], [], 0
    for place, text in enumerate(texts):
        text, at = (text or "").lower(), 0
        while at < len(text):
            cut = _SPACE.search(text, at + COUNT_CHARS) if len(text) - at > COUNT_CHARS else None
            end = cut.start() if cut else len(text)
            places.append(place)
            held.append(text[at:end])
            size, at = size + end - at, end
            if size >= COUNT_CHARS:
                yield places, held
                places, held, size = [], [], 0
    if held:
        yield places, held


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and the sum of n for each."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


class TermCounter:
    """Counts of a vocabulary's terms in texts."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        self.vocabulary = vocabulary
        self.beginnings = {t[:-1]: k for t, k in vocabulary.items() if t.endswith("*")}

    def _terms(self, words: pa.Array) -> np.ndarray:
        """Of each word a row: its term and those of its beginnings, -1 for what isn't known."""

        def known(names: pa.Array, of: dict[str, int]) -> np.ndarray:
            return np.fromiter(map(of.get, names.to_numpy(zero_copy_only=False), repeat(-1)), np.int64, len(names))

        sizes, out = pc.utf8_length(words).to_numpy(zero_copy_only=False), [known(words, self.vocabulary)]
        for n in BEGINNINGS:
            begun = pc.utf8_slice_codeunits(words, 0, n).dictionary_encode()
            out.append(np.where(sizes >= n, np.append(known(begun.dictionary, self.beginnings), -1)[begun.indices.to_numpy(zero_copy_only=False)], -1))
        return np.stack(out, axis=1)

    def counts(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text the places in rising order of its terms: the texts' bounds, the terms, their counts."""
        found = []
        for places, held in pieces(texts):
            split = pc.utf8_split_whitespace(pa.array(held, pa.large_string()))
            chunks = split.flatten().dictionary_encode()
            doc = np.repeat(np.array(places, np.int64), np.diff(split.offsets.to_numpy()))
            # each text's distinct chunks, then their words' terms
            key, n = summed(doc << 32 | chunks.indices.to_numpy(zero_copy_only=False), np.ones(len(doc), np.int64))
            inside = letters(chunks.dictionary)
            sizes, words = np.diff(inside.offsets.to_numpy()), inside.flatten().dictionary_encode()
            chunk = key & 0xFFFFFFFF
            word = words.indices.to_numpy(zero_copy_only=False)[ranges((np.cumsum(sizes) - sizes)[chunk], sizes[chunk])]
            doc, n = np.repeat(key & ~0xFFFFFFFF, sizes[chunk]), np.repeat(n, sizes[chunk])
            terms = self._terms(words.dictionary)[word]
            known = terms >= 0
            found.append(summed((doc[:, None] | terms)[known], np.repeat(n, known.sum(axis=1))))
        none = np.empty(0, np.int64)
        key, n = found[0] if len(found) == 1 else summed(np.concatenate([none, *(k for k, _ in found)]), np.concatenate([none, *(n for _, n in found)]))
        return np.searchsorted(key >> 32, np.arange(len(texts) + 1)), key & 0xFFFFFFFF, n


@dataclass
class BlockMaxIndex:
    """Postings by term and block of examples, with each term's greatest weight in each block."""

    labels: np.ndarray
    ids: list
    #: where each term's blocks start; of each (term, block) the block, the greatest weight, where its postings start and how many there are; of each posting the example's place and weight
    terms: np.ndarray = field(init=False)
    block: np.ndarray = field(init=False)
    top: np.ndarray = field(init=False)
    first: np.ndarray = field(init=False)
    size: np.ndarray = field(init=False)
    place: np.ndarray = field(init=False)
    weight: np.ndarray = field(init=False)
    #: the rows of frequent terms (-1: none), with a weight for each example and a greatest weight for each block
    row: np.ndarray = field(init=False)
    full: np.ndarray = field(init=False)
    full_top: np.ndarray = field(init=False)

    @classmethod
    def build(cls, vectors: list[tuple[np.ndarray, np.ndarray]], labels: Sequence[int], ids: Sequence, n_terms: int) -> BlockMaxIndex:
        """vectors: of each example its terms, ascending, and their weights."""
        # examples led by the same terms lie together, which makes the blocks' bounds tight
        led = [tuple(t[np.lexsort((t, -w))][:8].tolist()) for t, w in vectors]
        order = sorted(range(len(vectors)), key=lambda k: (led[k], k))
        self = cls(np.array([labels[k] for k in order], np.float64), [ids[k] for k in order])
        sizes = [len(vectors[k][0]) for k in order]
        term = np.concatenate([np.empty(0, np.int64), *(vectors[k][0] for k in order)]).astype(np.int64)
        weight = np.concatenate([np.empty(0), *(vectors[k][1] for k in order)])
        place = np.repeat(np.arange(len(order)), sizes)
        many = -(-len(order) // BLOCK)
        often = np.bincount(term, minlength=n_terms)
        frequent = np.lexsort((np.arange(n_terms), -often))[:FULL_TERMS]
        frequent = frequent[often[frequent] * FULL_SHARE >= max(1, len(order))]
        self.row = np.full(n_terms, -1, np.int64)
        self.row[frequent] = np.arange(len(frequent))
        self.full, full = np.zeros((len(frequent), many * BLOCK)), self.row[term] >= 0
        self.full[self.row[term[full]], place[full]] = weight[full]
        self.full_top = self.full.reshape(len(frequent), many, BLOCK).max(axis=2)
        term, place, weight = term[~full], place[~full], weight[~full]
        by = np.lexsort((place, term))
        term, self.place, self.weight = term[by], place[by].astype(np.int32), weight[by]
        key = term * (many + 1) + self.place // BLOCK
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        self.top = np.maximum.reduceat(self.weight, heads) if len(heads) else np.empty(0)
        self.block, self.first, self.size = self.place[heads] // BLOCK, heads, np.diff(np.append(heads, len(key)))
        self.terms = np.searchsorted(term[heads], np.arange(n_terms + 1))
        return self

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS, below: float = math.inf) -> list[tuple[float, int]]:
        """The k examples of greatest cosine above 0 (and below a bound) as (cosine, place); equal ones by place."""
        many, found = -(-len(self.ids) // BLOCK), (np.empty(0), np.empty(0, np.int64))
        row = self.row[terms]
        full, rows = weights[row >= 0], row[row >= 0]
        terms, weights = terms[row < 0], weights[row < 0]
        sizes = self.terms[terms + 1] - self.terms[terms]
        entries, each = ranges(self.terms[terms], sizes), np.repeat(weights, sizes)
        blocks = self.block[entries]
        bounds = np.bincount(blocks, weights=each * self.top[entries], minlength=many) + full @ self.full_top[rows]
        order = np.argsort(-bounds, kind="stable")
        # some of the best blocks give a least cosine, then all that can hold more are searched
        for take in (order[:FIRST_BLOCKS], order[FIRST_BLOCKS:]):
            least = found[0][k - 1] if len(found[0]) == k else 0.0
            take = take[(bounds[take] > 0) & (bounds[take] >= least - 1e-9)]
            if not len(take):
                break
            here = np.zeros(many, bool)
            here[take] = True
            mine = np.flatnonzero(here[blocks])
            at = entries[mine]
            n = self.size[at]
            posts = ranges(self.first[at], n)
            cosines = np.bincount(self.place[posts], weights=np.repeat(each[mine], n) * self.weight[posts], minlength=many * BLOCK).astype(np.float64)
            if 2 * len(take) >= many:
                cosines += full @ self.full[rows]
            else:
                for b in take.tolist():
                    cosines[b * BLOCK : (b + 1) * BLOCK] += full @ self.full[rows, b * BLOCK : (b + 1) * BLOCK]
            cosines = np.round(cosines, 12)
            cosines.reshape(many, BLOCK)[~here] = 0
            new = np.flatnonzero((cosines > 0) & (cosines >= least) & (cosines < below))
            cosine, place = np.concatenate([found[0], cosines[new]]), np.concatenate([found[1], new])
            best = np.lexsort((place, -cosine))[:k]
            found = cosine[best], place[best]
        return list(zip(found[0].tolist(), found[1].tolist(), strict=True))


def isotonic(xs: Sequence[float], ys: Sequence[float], weights: Sequence[float] | None = None) -> tuple[list[float], list[float]]:
    """Steps of a rising weighted fit: the value from each threshold on."""
    blocks: list[list[float]] = []
    for x, y, w in sorted(zip(xs, ys, weights if weights is not None else [1.0] * len(xs), strict=True)):
        if blocks and blocks[-1][0] == x:
            blocks[-1][1] += w * y
            blocks[-1][2] += w
        else:
            blocks.append([x, w * y, w])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            _, s, n = blocks.pop()
            blocks[-1][1] += s
            blocks[-1][2] += n
    return [b[0] for b in blocks], [b[1] / b[2] for b in blocks]


@dataclass
class ToxicityModel:
    vocabulary: dict[str, int]
    weights: np.ndarray
    index: BlockMaxIndex | None
    without: float
    steps: tuple[list[float], list[float]]

    def vectors(self, bounds: np.ndarray, terms: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The weights of unit TF-IDF vectors."""
        raw = (1.0 + np.log(n)) * self.weights[terms]
        sizes = np.diff(bounds)
        norms = np.sqrt(np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=raw * raw, minlength=len(sizes)))
        return raw / np.repeat(norms, sizes)

    def vote(self, terms: np.ndarray, weights: np.ndarray, below: float = math.inf) -> tuple[float, list[tuple[float, int]]]:
        near = self.index.nearest(terms, weights, below=below)
        votes = [1.0 / (1.05 - cosine) for cosine, _ in near]
        vote = sum(w * float(self.index.labels[at]) for w, (_, at) in zip(votes, near, strict=True))
        return round(vote / sum(votes), 9) if near else -1.0, near

    def calibrated(self, raw: float) -> float:
        if raw < 0 or not self.steps[0]:
            return self.without
        return self.steps[1][max(bisect.bisect_right(self.steps[0], raw) - 1, 0)]

    def score(self, texts: Sequence[str | None], counter: TermCounter, known: dict | None = None) -> list[tuple[float, list]]:
        """Of each text the calibrated score, and the ids of the examples that it rests on, nearest first."""
        if self.index is None:
            return [(self.without, [])] * len(texts)
        bounds, terms, n = counter.counts(texts)
        weights, out = self.vectors(bounds, terms, n), []
        known = {} if known is None else known
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            # texts with the same counts score the same
            key = terms[a:b].astype(np.int32).tobytes() + n[a:b].astype(np.int32).tobytes() if b - a < 2_000 else None
            if (done := known.get(key) if key is not None else None) is None:
                raw, near = self.vote(terms[a:b], weights[a:b])
                done = self.calibrated(raw), [self.index.ids[p] for _, p in near]
                if key is not None:
                    if len(known) >= 4_000:
                        known.clear()
                    known[key] = done
            out.append(done)
        return out


def held_out(column: str):
    """Whether a document is kept from the fit."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> tuple[DataFrame | None, float]:
    """doc_id, text, y and an order of the distinct texts of about `rows` labelled documents of each label; the share of label 1."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("y"))
    n = {r.y: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = n.get(1, 0) / max(1, sum(n.values()))
    if len(n) < 2:
        return None, share
    at = F.pmod(F.xxhash64(F.lit(11), F.col("doc_id")), F.lit(1 << 30))
    keep = F.when(F.col("y") == 1, at < int((1 << 30) * min(1.0, rows / n[1]))).otherwise(at < int((1 << 30) * min(1.0, rows / n[0])))
    # at most about twice `rows` ids are broadcast
    ids = known.where(keep).select("doc_id", "y", F.xxhash64(F.lit(12), F.col("doc_id")).alias("rank"))
    found = docs.join(F.broadcast(ids), "doc_id").groupBy("text", "y").agg(F.min("rank").alias("rank"), F.min("doc_id").alias("doc_id"))
    return materialise(found.select("doc_id", "text", "y", "rank"), "toxicity-sample"), share


def _examples(sample: DataFrame) -> list[tuple]:
    """doc_id, y, terms and counts of the examples: the first of each label in the sample's order, within the bounds."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = batch.column(3).to_pylist()
            words = pa.chunked_array([letters(pa.array(held, pa.large_string())).flatten() for _, held in pieces(texts)] or [pa.array([], pa.large_string())]).unique()
            names = np.array(terms_of([w for w in words.to_pylist() if w]), object)
            bounds, terms, n = TermCounter({t: k for k, t in enumerate(names)}).counts(texts)
            offsets = pa.array(bounds, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(names[terms] if len(names) else [], pa.string())), pa.ListArray.from_arrays(offsets, pa.array(n, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(bounds), pa.int64()), *lists], ["doc_id", "y", "rank", "size", "terms", "n"])

    kind = dict(sample.dtypes)["doc_id"]
    ranked = []
    for y in (0, 1):
        last = sample.where(F.col("y") == y).select("rank").orderBy("rank").limit(EXAMPLES).agg(F.max("rank")).first()[0]
        first = sample.where((F.col("y") == y) & (F.col("rank") <= (last if last is not None else 0)))
        counted = materialise(first.select("doc_id", "y", "rank", "text").mapInArrow(lean(run), f"doc_id {kind}, y int, rank bigint, size bigint, terms array<string>, n array<bigint>"), "toxicity-examples")
        sizes = sorted((r["rank"], r.doc_id, r["size"]) for r in counted.select("rank", "doc_id", "size").collect())
        total, last = 0, None
        for at, doc, size in sizes:
            if (total := total + size) > EXAMPLE_TERMS // 2:
                break
            last = (at, doc)
        if last:
            table = counted.where((F.col("rank") < last[0]) | (F.col("rank") == last[0]) & (F.col("doc_id") <= last[1])).where("size > 0").orderBy("rank", "doc_id").toArrow()
            ranked += list(zip(table["doc_id"].to_pylist(), table["y"].to_pylist(), table["terms"], table["n"], strict=True))
    return ranked


def document_frequencies(rows: DataFrame, vocabulary, slices: int) -> dict[int, np.ndarray]:
    """For each value of g, and -1 for the number of rows of that g, how many rows have each term. rows: g int, text.

    Every task counts its rows; the counts are summed by slices of the vocabulary, which has a bounded size.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = len(vocabulary.value)
        counter, sums = TermCounter(vocabulary.value), {}
        for batch in it:
            groups, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for g in np.unique(groups).tolist():
                mine = [t for t, x in zip(texts, groups == g, strict=True) if x]
                _, terms, _ = counter.counts(mine)
                total = sums.setdefault(g, np.zeros(many + 1, np.int64))
                total[:many] += np.bincount(terms, minlength=many)
                total[many] += len(mine)
        parts = [(g, k, pack(x)) for g, total in sums.items() for k, x in enumerate(np.array_split(total, slices))]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.int32()), pa.array([p[2] for p in parts], pa.binary())], ["g", "part", "n"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for blob in batch.column("n").to_pylist():
                x = unpack(blob)[0]
                total = x if total is None else total + x
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([pack(total)], pa.binary())], ["g", "part", "n"])

    counted = rows.select("g", "text").mapInArrow(lean(run), "g int, part int, n binary").groupBy("g", "part").applyInArrow(add, "g int, part int, n binary")
    found: dict[int, dict[int, np.ndarray]] = {}
    for r in counted.collect():
        found.setdefault(r.g, {})[r.part] = unpack(bytes(r.n))[0]
    return {g: np.concatenate([parts[k] for k in sorted(parts)]) for g, parts in found.items()}


def dependence(with_term: np.ndarray, rows: float, with_toxic: np.ndarray, toxic: float) -> np.ndarray:
    """How much each term's presence depends on the label: the phi coefficient, corrected for continuity."""
    n0, n1, total = rows - toxic, toxic, rows
    a, b = with_term - with_toxic, with_toxic
    off = np.maximum(0.0, np.abs(b * n0 - a * n1) - total / 2)
    spread = with_term * (total - with_term) * n0 * n1
    return np.where(spread > 0, off / np.sqrt(np.maximum(spread, 1.0)), 0.0)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """docs: doc_id, text; labels: doc_id, toxic. Held-out documents' labels aren't used."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    sample, share = _sample(docs, labels, sample_rows)
    examples = _examples(sample) if sample is not None else []
    if len({y for _, y, _, _ in examples}) < 2:
        return ToxicityModel({}, np.empty(0), None, share, ([], []))
    names = pa.chunked_array([terms.values for _, _, terms, _ in examples]).unique().to_pylist()
    vocabulary = {t: k for k, t in enumerate(sorted(names))}
    shared = spark.sparkContext.broadcast(vocabulary)
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    told = document_frequencies(sample.select(F.col("y").alias("g"), "text"), shared, slices)
    corpus = document_frequencies(docs.select(F.lit(0).alias("g"), "text"), shared, slices)[0]
    both = told[0] + told[1]
    depends = dependence(both[:-1].astype(float), float(both[-1]), told[1][:-1].astype(float), float(told[1][-1]))
    idf = np.log((1 + corpus[-1]) / (1 + corpus[:-1])) + 1.0
    model = ToxicityModel(vocabulary, idf * (LEAST_FACTOR + depends), None, share, ([], []))
    vectors = []
    for _, _, terms, n in examples:
        at = np.array([vocabulary[t] for t in terms.as_py()], np.int64)
        by = np.argsort(at)
        vectors.append((at[by], model.vectors(np.array([0, len(at)]), at[by], np.array(n.as_py())[by])))
    model.index = BlockMaxIndex.build(vectors, [y for _, y, _, _ in examples], [doc for doc, _, _, _ in examples], len(vocabulary))
    _calibrate(model, sample, share)
    return model


def _calibrate(model: ToxicityModel, sample: DataFrame, share: float) -> None:
    """From the votes of the sample's rows, each without the examples equal to it."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        counter = TermCounter(held.vocabulary)
        for batch in it:
            bounds, terms, n = counter.counts(batch.column(1).to_pylist())
            weights = held.vectors(bounds, terms, n)
            raw = [held.vote(terms[a:b], weights[a:b], 1 - 1e-9)[0] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.float64())], ["y", "raw"])

    # bounded by the sample
    voted = sample.select("y", "text").mapInArrow(lean(run), "y int, raw double").collect()
    n1 = sum(r.y for r in voted)
    # the sample has the labels in other shares than the corpus: each row weighs by its label's share
    weight = {1: share / max(1, n1), 0: (1 - share) / max(1, len(voted) - n1)}
    # texts without a term: their share of label 1, and one row more that has the corpus' share
    none = [sum(r.raw < 0 and r.y == y for r in voted) * weight[y] for y in (0, 1)]
    more = 1 / max(1, len(voted))
    model.without = (none[1] + share * more) / (none[0] + none[1] + more)
    rows = sorted((r.raw, r.y) for r in voted if r.raw >= 0)
    model.steps = isotonic([x for x, _ in rows], [float(y) for _, y in rows], [weight[y] for _, y in rows])


def reject(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose text scores below the threshold; one narrow pass."""
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = shared.value, {}
        counter = TermCounter(held.vocabulary)
        for batch in it:
            yield batch.filter(pa.array([s < threshold for s, _ in held.score(batch.column(at).to_pylist(), counter, known)], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted and evidence, the ids of the nearest examples."""
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = shared.value, {}
        counter = TermCounter(held.vocabulary)
        for batch in it:
            rows = held.score(batch.column(2).to_pylist(), counter, known)
            cols = [pa.array([s for s, _ in rows], pa.float64()), pa.array([e for _, e in rows], pa.list_(batch.schema.field(0).type))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["doc_id", "held_out", "score", "evidence"])

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(lean(run), f"doc_id {kind}, held_out boolean, score double, evidence array<{kind}>")
    return scored.select(F.col("doc_id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
