"""Token counts by heap-and-linked-list byte-pair merging.

The vocabulary file gives merge ranks. A text is cut into pre-tokens; each is a linked list of byte symbols, and a
heap holds its adjacent pairs by rank. The lowest pair is popped and merged until none is left: the count is the
initial symbols minus the merges. No identifiers are made. Counts of pieces already met are kept in a bounded table.

Defined results: a null text counts as empty (0 tokens); an empty text has 0 tokens; a text of any length is handled
whole; strings of special tokens inside a text count as one token each, as the library does by default.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces whose counts a worker remembers, and the characters of the longest of them.
CACHE_ENTRIES, CACHE_CHARS = 300_000, 64
#: Texts above this many characters are cut piece by piece instead of all at once.
LONG_TEXT = 1 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, others for 256 and up."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairRanks:
    """Merge ranks over symbol numbers: a byte is 0..255, the result of merge r is 256 + r unless its bytes have a number."""

    def __init__(self, merges: list) -> None:
        back = byte_alphabet()
        number = {ch: b for ch, b in back.items()}
        self.rank: dict[int, int] = {}
        self.result: list[int] = []
        for r, m in enumerate(merges):
            left, right = m if not isinstance(m, str) else m.split(" ")
            made = number.setdefault(left + right, 256 + r)
            self.rank.setdefault(number[left] << 32 | number[right], r)
            self.result.append(made)

    def count(self, piece: bytes) -> int:
        """Symbols left of a piece after all merges."""
        n = len(piece)
        if n < 2:
            return n
        rank, result = self.rank, self.result
        sym = list(piece)
        # the linked list: next and previous living position
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = rank.get(sym[i] << 32 | sym[i + 1])
            if r is not None:
                heap.append(r << 32 | i)
        heapify(heap)
        left = n
        while heap:
            top = heappop(heap)
            r, i = top >> 32, top & 0xFFFFFFFF
            j = nxt[i]
            if sym[i] < 0 or j >= n or rank.get(sym[i] << 32 | sym[j]) != r:
                continue  # a neighbour has merged meanwhile
            sym[i], sym[j] = result[r], -1
            left -= 1
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                x = rank.get(sym[i] << 32 | sym[k])
                if x is not None:
                    heappush(heap, x << 32 | i)
            h = prv[i]
            if h >= 0:
                x = rank.get(sym[h] << 32 | sym[i])
                if x is not None:
                    heappush(heap, x << 32 | h)
        return left


#: Fixed value: how byte-level vocabularies of this kind cut a text into pre-tokens.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Python's \s also takes these four, which the library's doesn't.
SEPARATORS = re.compile("[\x1c-\x1f]")
SPACED = PRETOKENS.replace(r"\s", r"[^\S\x1c-\x1f]").replace(r"[^[^\S\x1c-\x1f]\p{L}\p{N}]", r"(?:[^\s\p{L}\p{N}]|[\x1c-\x1f])").replace(r"(?!\S)", r"(?![\S\x1c-\x1f])")


class _Counts(dict):
    """Counts by piece, made when missing; emptied when full."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> int:
        n = self.make(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[key] = n
        return n


class TokenCounter:
    """Counts the tokens of texts by the merges of a byte-level vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError("a plain byte-level BPE vocabulary is needed")
        self.ranks = PairRanks(model["merges"])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.cut = regex.compile(PRETOKENS)
        self.cut_separators = regex.compile(SPACED)
        self.space_run = re.compile(r" \s|\s $")
        self.pieces = _Counts(lambda p: self.ranks.count(p.encode()))
        #: By text between two single spaces, the first space included.
        self.units = _Counts(lambda u: sum(map(self.pieces.__getitem__, self.cut.findall(" " + u))))

    def _plain(self, text: str) -> int:
        if SEPARATORS.search(text):
            return sum(self.pieces[m.group()] for m in self.cut_separators.finditer(text))
        if len(text) > LONG_TEXT or self.space_run.search(text):
            return sum(self.pieces[m.group()] for m in self.cut.finditer(text)) if len(text) > LONG_TEXT else sum(map(self.pieces.__getitem__, self.cut.findall(text)))
        # every space starts a pre-token here, so units between spaces count alone
        first, *rest = text.split(" ")
        n = sum(map(self.pieces.__getitem__, self.cut.findall(first))) if first else 0
        return n + sum(map(self.units.__getitem__, rest))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or "<" not in text:
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self._plain(p) for p in parts if p)


_COUNTERS: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, vocabulary: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit. One narrow pass: no shuffle."""
    types = dict(docs.dtypes)
    schema = f"`{id_col}` {types[id_col]}, n_bytes bigint, n_tokens bigint"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for batch in it:
            tokens = pa.array([count(t) for t in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), tokens], [id_col, "n_bytes", "n_tokens"])

    sized = docs.select(F.col(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col))
    return sized.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
