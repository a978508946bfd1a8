"""Substring deduplication by difference-cover anchors.

A window is WINDOW words. Positions of a text whose residue modulo PERIOD lies in COVER are anchors, each with the hash
of the ANCHOR words from there. Every difference of residues is one of two members of COVER, so wherever two equal
windows lie, one of the first PERIOD positions is an anchor in both, aligned: ANCHOR + PERIOD - 1 = WINDOW words hold it.

Only anchors' hashes are shuffled at first. Those met in more than one place extend: the windows around them, and no
others, are compared by a 80-bit hash, and each learns whether its words also start in a document with a smaller id.
Tasks settle what they can by themselves and send one record for each value: a passage that a third of all documents
share costs a record for each task's batch, not for each document. Records travel in compressed blobs by bucket; a
bucket's replies go back by batch.

Defined results: a null text has no words; windows never cross documents; a null id counts as larger than any other;
rows that repeat an id aren't smaller than each other; repeated rows get equal results; texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ssaflow.llm.common import bucket_count, deltas, pack, unpack, word_blocks

WINDOW, PERIOD, COVER, ANCHOR = 13, 7, (0, 1, 3), 7
#: Words that a task handles at a time; a longer text is handled alone.
BATCH_WORDS = 1 << 20
#: Stands for a null id.
LAST_ID = (1 << 63) - 1
#: Bits of an anchor's hash; chance meetings only cost a comparison.
ANCHOR_BITS = 48

_MASK = (1 << 64) - 1
_MULTIPLIERS = np.array([xxhash.xxh64_intdigest(bytes([k]), 2024) | 1 for k in range(2 * WINDOW + ANCHOR)], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 & _MASK)
    return h ^ (h >> np.uint64(29))


def rolling(words: np.ndarray, width: int, first: int) -> np.ndarray:
    """A hash of each run of width word hashes."""
    n = len(words) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(width if n > 0 else 0):
        out += words[j : j + n] * _MULTIPLIERS[first + j]
    return _mixed(out)


def word_hashes(data: bytes) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.concatenate([np.array([digest(w) for w in block], np.uint64) for block in word_blocks(data)])


def _by_bucket(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The rows of each bucket, in their order."""
    order = np.argsort(bucket, kind="stable")
    if len(order):
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            yield int(bucket[part[0]]), [c[part] for c in columns]


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts by keys, the first being the most significant, stably; and where groups of equal ones begin."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, np.flatnonzero(new)


class _Batch:
    """Texts of one task that are handled together: ids, text hashes and one array of all their words' hashes."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.marks: list[int] = []
        self.words: list[np.ndarray] = []
        self.extra: list = []
        self.size = 0

    def add(self, doc: int | None, mark: int, words: np.ndarray, extra=None) -> None:
        self.ids.append(LAST_ID if doc is None else doc)
        self.marks.append(mark)
        self.words.append(words)
        self.extra.append(extra)
        self.size += len(words)

    def laid_out(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words' hashes, where each text begins and how long it is."""
        sizes = np.array([len(w) for w in self.words], np.int64)
        return np.concatenate(self.words), np.cumsum(sizes) - sizes, sizes

    def manifest(self, *arrays: np.ndarray) -> bytes:
        _, begins, _ = self.laid_out()
        return pack(np.array(self.ids, np.int64), np.array(self.marks, np.int64), begins, *arrays)


#: What batches send: a bucket's records, or (kind 1) the batch's own notes, which only pass through.
SENT = "bucket bigint, batch bigint, kind int, blob binary"
REPLY = "batch bigint, kind int, blob binary"
_SENT = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])
_REPLY = pa.schema([("batch", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])


def _send(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SENT, strict=True)], schema=_SENT)


def anchor_positions(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of all anchors in texts that lie one after another."""
    counts = np.maximum(sizes - ANCHOR + 1, 0)
    at = np.repeat(begins, counts) + (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
    residue = (at - np.repeat(begins, counts)) % PERIOD
    return at[np.isin(residue, COVER)]


def _anchor_records(batch: _Batch, number: int, buckets: int) -> pa.RecordBatch:
    words, begins, sizes = batch.laid_out()
    at = anchor_positions(begins, sizes)
    key = rolling(words, ANCHOR, 2 * WINDOW)[at] >> np.uint64(64 - ANCHOR_BITS)
    text = np.searchsorted(begins, at, "right") - 1
    order, starts = _groups(key)
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
    first = order[starts]
    # met in two texts of this batch: settled here
    shared = np.zeros(len(starts), bool)
    shared[group[text[order] != text[first][group]]] = True
    here = np.sort(at[order[shared[group]]])
    # others of a value that one text has several times follow the first
    later = np.ones(len(order), bool)
    later[starts] = False
    later &= ~shared[group]
    notes = batch.manifest(here, at[order[later]], at[first][group[later]])
    rows = [(number % buckets, number, 1, notes)]
    one = np.sort(first)
    bucket = (key[one] % np.uint64(buckets)).astype(np.int64)
    for b, (where, value) in _by_bucket(bucket, [at[one], key[one] // np.uint64(buckets)]):
        rows.append((b, number, 0, pack(deltas(where), value)))
    return _send(rows)


def _reply(table: pa.Table, settle: Callable[[list[list[np.ndarray]]], list[np.ndarray]]) -> pa.Table:
    """settle gets each batch's records in a bucket and gives the positions to report back to each."""
    columns = zip(*(table.column(n).to_pylist() for n in ("batch", "kind", "blob")), strict=True)
    mine, out = [], []
    for batch, kind, blob in columns:
        if kind == 1:
            out.append((batch, 1, blob))
        else:
            mine.append((batch, unpack(blob)))
    for (batch, _), told in zip(mine, settle([r for _, r in mine]) if mine else [], strict=True):
        if len(told):
            out.append((batch, 0, pack(deltas(np.sort(told)))))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 3, _REPLY, strict=True)], schema=_REPLY)


def _met_elsewhere(records: list[list[np.ndarray]]) -> list[np.ndarray]:
    """For each batch the positions of anchors that another batch has too."""
    keys = np.concatenate([r[1] for r in records])
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    twice = np.split(counts[inverse] > 1, np.cumsum([len(r[1]) for r in records])[:-1])
    return [np.cumsum(r[0])[t] for r, t in zip(records, twice, strict=True)]


def _smaller_elsewhere(records: list[list[np.ndarray]]) -> list[np.ndarray]:
    """For each batch the positions of windows that a smaller id of another batch has too."""
    high, low, doc = (np.concatenate([r[k] for r in records]) for k in (1, 2, 3))
    order, starts = _groups(high, low)
    least = np.repeat(np.minimum.reduceat(doc[order], starts), np.diff(np.append(starts, len(order))))
    beaten = np.empty(len(order), bool)
    beaten[order] = doc[order] > least
    return [np.cumsum(r[0])[t] for r, t in zip(records, np.split(beaten, np.cumsum([len(r[1]) for r in records])[:-1]), strict=True)]


def _gather(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A batch's ids, text hashes, begins, and all positions told or known to be so."""
    notes, told = None, []
    for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist(), strict=True):
        if kind == 1:
            notes = unpack(blob)
        else:
            told.append(np.cumsum(unpack(blob)[0]))
    ids, marks, begins, here, alias, of = notes
    told = np.concatenate(told) if told else np.empty(0, np.int64)
    return ids, marks, begins, np.unique(np.concatenate([here, told, alias[np.isin(of, told)]]))


FOUND = "id bigint, mark bigint, places binary"
_FOUND = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("places", pa.binary())])


def _per_text(table: pa.Table, blob: Callable[[np.ndarray], bytes]) -> pa.Table:
    """A row for each text with positions: id, text hash and blob(positions from its begin)."""
    ids, marks, begins, at = _gather(table)
    rows: tuple[list, list, list] = ([], [], [])
    if len(at):
        text = np.searchsorted(begins, at, "right") - 1
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(text)) + 1):
            k = text[part[0]]
            for column, value in zip(rows, (ids[k], marks[k], blob(at[part] - begins[k])), strict=True):
                column.append(value)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _FOUND, strict=True)], schema=_FOUND)


def covered(starts: np.ndarray) -> bytes:
    """The ranges of words that windows from starts (sorted) cover, as begins and ends."""
    cut = np.flatnonzero(np.diff(starts) > WINDOW)
    begins = np.concatenate([starts[:1], starts[cut + 1]])
    ends = np.concatenate([starts[cut], starts[-1:]]) + WINDOW
    return pack(begins, ends)


def _window_records(batch: _Batch, number: int, buckets: int) -> pa.RecordBatch:
    words, begins, sizes = batch.laid_out()
    # windows around each anchor that was met elsewhere
    edge = np.zeros(len(words) + 1, np.int32)
    for begin, size, anchors in zip(begins, sizes, batch.extra, strict=True):
        last = size - WINDOW
        lo = np.maximum(anchors - (WINDOW - ANCHOR), 0)
        hi = np.minimum(anchors, last)
        np.add.at(edge, begin + lo, 1)
        np.add.at(edge, begin + hi + 1, -1)
    at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    high = rolling(words, WINDOW, 0)[at]
    low = (rolling(words, WINDOW, WINDOW)[at] >> np.uint64(48)).astype(np.uint16)
    doc = np.array(batch.ids, np.int64)[np.searchsorted(begins, at, "right") - 1]
    order, starts = _groups(high, low, doc)
    # the groups of equal windows, whatever the document
    h, v, d = high[order], low[order], doc[order]
    new = np.ones(len(order), bool)
    new[1:] = (h[1:] != h[:-1]) | (v[1:] != v[:-1])
    group = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    beaten = d > d[head][group] if len(order) else np.empty(0, bool)
    later = ~beaten & ~new
    notes = batch.manifest(np.sort(at[order[beaten]]), at[order[later]], at[order[head]][group[later]])
    rows = [(number % buckets, number, 1, notes)]
    one = np.sort(order[head])
    bucket = (high[one] % np.uint64(buckets)).astype(np.int64)
    for b, (where, hh, ll, dd) in _by_bucket(bucket, [at[one], high[one] // np.uint64(buckets), low[one], doc[one]]):
        rows.append((b, number, 0, pack(deltas(where), hh, ll, dd)))
    return _send(rows)


def _numbered(texts: Callable[[pa.RecordBatch], Iterator[tuple]], records: Callable[[_Batch, int, int], pa.RecordBatch], buckets: int):
    """A map over partitions that sends each batch's records under a number of its own."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, number = _Batch(), TaskContext.get().partitionId() << 32
        for rows in it:
            for text in texts(rows):
                batch.add(*text)
                if batch.size >= BATCH_WORDS:
                    yield records(batch, number, buckets)
                    batch, number = _Batch(), number + 1
        if batch.size:
            yield records(batch, number, buckets)

    return run


def _texts(rows: pa.RecordBatch) -> Iterator[tuple]:
    for doc, mark, text in zip(*(rows.column(n).to_pylist() for n in ("id", "mark", "text")), strict=True):
        if text:
            words = word_hashes(text.encode())
            if len(words) >= WINDOW:
                yield doc, mark, words


def _texts_with_anchors(rows: pa.RecordBatch) -> Iterator[tuple]:
    for doc, mark, text, places in zip(*(rows.column(n).to_pylist() for n in ("id", "mark", "text", "places")), strict=True):
        yield doc, mark, word_hashes(text.encode()), unpack(places)[0].astype(np.int64)


def _grouped(sent: DataFrame, settle, blob) -> DataFrame:
    """Settle the records bucket by bucket, bring the replies together batch by batch."""
    replies = sent.groupBy("bucket").applyInArrow(lambda t: _reply(t, settle), REPLY)
    found = replies.groupBy("batch").applyInArrow(lambda t: _per_text(t, blob), FOUND)
    # repeated rows have equal places
    return found.dropDuplicates(["id", "mark"])


def repeated_ranges(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """docs: id, mark, text and maybe more. A row for each text with words to remove: id, mark, places (ranges' begins and ends)."""
    buckets = buckets or bucket_count(docs)
    anchors = _grouped(docs.select("id", "mark", "text").mapInArrow(_numbered(_texts, _anchor_records, buckets), SENT), _met_elsewhere, lambda at: pack(at.astype(np.int32)))
    # a task that runs again must number its batches alike
    candidates = docs.join(anchors, ["id", "mark"]).sortWithinPartitions("id", "mark")
    return _grouped(candidates.mapInArrow(_numbered(_texts_with_anchors, _window_records, buckets), SENT), _smaller_elsewhere, covered)


def split_words(text: str | None, places: bytes | None) -> tuple[int, list[bytes]]:
    """The number of words and the words that are kept."""
    words = text.encode().split() if text else []
    if places is None:
        return len(words), words
    keep = np.ones(len(words), bool)
    for begin, end in zip(*unpack(places), strict=True):
        keep[begin:end] = False
    return len(words), [words[k] for k in np.flatnonzero(keep)]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256, and kept_text where asked for."""
    kind = dict(docs.dtypes)[id_col]
    whole = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST_ID)).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    # both joins deal the same columns by the same keys: the texts are shuffled once
    places = repeated_ranges(whole)
    out = f"`{id_col}` {kind}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for text, where in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist(), strict=True):
                n, kept = split_words(text, where)
                joined = b" ".join(kept)
                rows.append((n, n - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode()))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            made = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)][: 4 if with_text else 3]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *made], [id_col, "n_words", "n_removed", "kept_sha256", "kept_text"][: 5 if with_text else 4])

    return whole.join(places, ["id", "mark"], "left").mapInArrow(run, out)
