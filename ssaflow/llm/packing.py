"""Bounded-space online packing of tokenised documents into sequences of a fixed window.

Each partition keeps at most a fixed number of open windows. A document first gives its full windows; the rest of it
goes to the open window that it fills best. When none has room and no more may be opened, the fullest is topped up
with the head of the piece and emitted. What is left open at a partition's end is packed again, piece by piece, with
that of neighbouring partitions, which bounds both the rows a merge sees and the padding.

Defined results: a null text counts as empty (its only id is the end id); every id lies in exactly one piece; a text of
any length is handled whole; repeated rows are packed as often as they occur; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ssaflow.llm.common import lean, materialise
from ssaflow.llm.tokens import byte_alphabet

#: Chunks, and pieces, whose ids a worker remembers, and the characters of the longest of them.
CACHE_ENTRIES, CACHE_CHARS = 300_000, 64
#: Partitions whose leftovers are merged together.
MERGE_PARTITIONS = 8


#: Fixed value: how vocabularies of this kind cut lower-cased text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _remember(cache: dict, key: str, ids: bytes) -> bytes:
    if len(key) <= CACHE_CHARS:
        if len(cache) >= CACHE_ENTRIES:
            cache.clear()
        cache[key] = ids
    return ids


def _special_strings(path: str) -> re.Pattern:
    """What finds the file's added tokens in a text; a file of another kind is refused."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    parts = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    split = cuts[0].get("type") == "Split" and cuts[0]["pattern"] == {"Regex": PIECES} and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"]
    if spec["model"]["type"] != "BPE" or parts != ["NFC", "Replace", "Lowercase"] or not split or cuts[1:2] != [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]:
        raise ValueError("a byte-level BPE vocabulary of lower-cased pieces is needed")
    return re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")


class _PieceIds(dict):
    """The ids of single pieces that are normalised already, from the library's model alone."""

    def __init__(self, library) -> None:
        super().__init__()
        self.model = library.model
        self.byte_chars = {b: ch for ch, b in byte_alphabet().items()}

    def __missing__(self, piece: str) -> bytes:
        symbols = piece if piece.isascii() and piece.isprintable() else "".join([self.byte_chars[b] for b in piece.encode()])
        return _remember(self, piece, array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes())


class ChunkIds(dict):
    """The ids of text between white space, as bytes of little-endian unsigned 32-bit numbers; emptied when full.

    The vocabulary drops white space and no token crosses it, so chunks tokenise alone; chunks share their pieces.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.special = _special_strings(path)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.normal = self.library.normalizer.normalize_str
        self.pieces, self.cut = _PieceIds(self.library), regex.compile(PIECES)

    def encode(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        plain = chunk.lower() if chunk.isascii() else self.normal(chunk)
        if plain.isalpha():
            ids = self.pieces[plain]
        elif plain[-1:] in ".,:;!?" and plain[:-1].isalpha():
            ids = self.pieces[plain[:-1]] + self.pieces[plain[-1]]
        else:
            ids = b"".join(map(self.pieces.__getitem__, self.cut.findall(plain)))
        return _remember(self, chunk, ids)

    def of_text(self, text: str) -> bytes:
        # special strings may hold any characters, and Python's split knows four more separators
        if self.special.search(text) or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self.encode(text)
        return b"".join(map(self.__getitem__, text.split()))


_IDS: dict[str, ChunkIds] = {}


def chunk_ids(path: str) -> ChunkIds:
    if path not in _IDS:
        _IDS[path] = ChunkIds(path)
    return _IDS[path]


class OpenWindows:
    """At most `limit` windows with room left. A piece is any list whose item LENGTH is its length."""

    def __init__(self, size: int, limit: int, first_id: int) -> None:
        self.size, self.limit, self.next_id = size, limit, first_id
        self.open: dict[int, tuple[int, list]] = {}

    def fresh(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def best_fit(self, length: int) -> int | None:
        best, room = None, self.size + 1
        for k, (used, _) in self.open.items():
            if length <= self.size - used < room:
                best, room = k, self.size - used
        return best

    def fullest(self) -> int:
        return max(self.open, key=lambda k: self.open[k][0])

    def put(self, key: int, length: int, piece: tuple) -> list | None:
        """Add the piece; its window's (piece, offset) list once that is full."""
        used, held = self.open.get(key, (0, []))
        held.append((piece, used))
        if used + length == self.size:
            self.open.pop(key, None)
            return held
        self.open[key] = (used + length, held)
        return None


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _pack_partition(vocabulary: str, end_id: int, size: int, limit: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = chunk_ids(vocabulary)
        part = TaskContext.get().partitionId()
        windows = OpenWindows(size, limit, part << 32)
        out: list[tuple] = []

        def emit(key: int, held: list, merge: int | None) -> None:
            out.extend((*piece, key, offset, merge) for piece, offset in held)

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[]] * 8
            out.clear()
            kinds = [id_type, *[pa.int64()] * 6, pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [*COLUMNS, "merge_group"])

        id_type = pa.int64()
        for batch in it:
            id_type = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = (ids_of.of_text(text) if text else b"") + end
                total, at = len(ids) // 4, 0
                while at < total:
                    rest = total - at
                    key, n = None, rest
                    if rest >= size:
                        key, n = windows.fresh(), size
                    elif (key := windows.best_fit(rest)) is None:
                        if len(windows.open) < limit:
                            key = windows.fresh()
                        else:
                            key = windows.fullest()
                            n = size - windows.open[key][0]
                    piece = (doc, at, n, zlib.crc32(memoryview(ids)[4 * at : 4 * (at + n)]), total)
                    if full := windows.put(key, n, piece):
                        emit(key, full, None)
                    at += n
            if len(out) > 4096:
                yield flush()
        for key, (_, held) in windows.open.items():
            emit(key, held, part // MERGE_PARTITIONS)
        yield flush()

    return run


def _merge_leftovers(size: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # largest first, best fit, and as many windows as it takes
        pdf = pdf.sort_values(["length", "sequence_id", "offset"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        windows = OpenWindows(size, len(pdf), (1 << 62) + (int(pdf.merge_group[0]) << 32))
        keys, offsets = [], []
        for n in pdf.length:
            key = windows.best_fit(n)
            key = windows.fresh() if key is None else key
            keys.append(key)
            offsets.append(windows.open.get(key, (0,))[0])
            windows.put(key, n, ())
        return pdf.assign(sequence_id=keys, offset=offsets)[COLUMNS]

    return run


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, window: int = 2048, open_windows: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: the document, its place there, the checksum of its ids, its sequence and its place there."""
    kind = dict(docs.dtypes)[id_col]
    plain = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    run = _pack_partition(vocabulary, end_id, window, open_windows)
    placed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"{plain}, merge_group bigint")
    # tokenised once: the closed sequences are the result, the open ones are packed again
    placed = materialise(placed, "packing")
    closed = placed.where(F.col("merge_group").isNull()).select(COLUMNS)
    merged = placed.where(F.col("merge_group").isNotNull()).groupBy("merge_group").applyInPandas(_merge_leftovers(window), plain)
    return closed.unionByName(merged)
