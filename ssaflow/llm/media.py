"""Media columns: content-addressed payloads in tar shards.

A text's bytes, padded with spaces to a whole number of rows, become the 8-bit samples of a grey image (PNG, lossless).
Each writing task stores a payload once, by the strong digest of its bytes, as a member of its own tar shards. Rows
carry shard, offset and length; one place is chosen for each digest. Reading goes shard by shard: a range read of the
image's header alone fills the metadata columns, and one of the whole member gives back the samples and features.

Defined results: a null text counts as empty and, like it, is one row of spaces; equal texts have equal values, however
often they occur; texts of any length are stored whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ssaflow.llm.common import materialise, open_fs, shared_dir

#: Samples in an image row.
WIDTH = 192
#: A shard is closed when it has so many bytes.
SHARD_BYTES = 64 << 20
#: Bytes of an image up to the end of its header chunk.
HEADER_BYTES = 33
#: Fixed value: how images of this format begin.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Tar's unit.
BLOCK = 512


def padded(data: bytes, width: int = WIDTH) -> bytes:
    """The payload: data with spaces up to a positive multiple of width."""
    return data + b" " * (max(width, -(-len(data) // width) * width) - len(data))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_image(payload: bytes, width: int = WIDTH, level: int = 6) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    filtered = np.zeros((len(rows), width + 1), np.uint8)  # filter type 0 before each row
    filtered[:, 1:] = rows
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), level)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample, from the first bytes of an image alone."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not an image of this format")
    width, height, depth = struct.unpack(">IIB", head[16:25])
    return width, height, depth


def decode_image(media: bytes) -> bytes:
    """The samples; every chunk's checksum is verified."""
    width, height, depth = read_header(media)
    at, data = 8, []
    while at < len(media):
        (n,) = struct.unpack(">I", media[at : at + 4])
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if depth != 8 or rows[:, 0].any():
        raise ValueError("only unfiltered 8-bit samples are written here")
    return rows[:, 1:].tobytes()


def features(samples: bytes) -> str:
    """Mean, deviation and entropy of the samples, and the shares of letters, spaces, digits and bytes beyond ASCII."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256).astype(np.float64)
    p = counts / counts.sum()
    v = np.arange(256)
    mean = float(p @ v)
    some = p[p > 0]
    shares = p[65:91].sum() + p[97:123].sum(), p[32] + p[9:14].sum(), p[48:58].sum(), p[128:].sum()
    return ";".join(f"{x + 0.0:.6f}" for x in (mean, float(p @ (v - mean) ** 2) ** 0.5, float(abs(-(some * np.log2(some)).sum())), *map(float, shares)))


class ShardWriter:
    """Writes tar shards below a folder; a payload already written by this task isn't written again."""

    def __init__(self, folder: str, part: int) -> None:
        self.folder, self.part = folder, part
        self.attempt, self.number = uuid.uuid4().hex[:12], 0
        self.seen: dict[bytes, tuple[str, int, int]] = {}
        self.buffer = io.BytesIO()

    @property
    def name(self) -> str:
        # an attempt's shards have names of their own: a retry never changes what rows of another attempt point to
        return f"shard-{self.part:06d}-{self.number:04d}-{self.attempt}.tar"

    def put(self, digest: bytes, payload: bytes) -> tuple[str, int, int]:
        if place := self.seen.get(digest):
            return place
        media = encode_image(payload)
        info = tarfile.TarInfo(f"{digest.hex()}.png")
        info.size = len(media)
        self.buffer.write(info.tobuf(tarfile.USTAR_FORMAT))
        place = (self.name, self.buffer.tell(), len(media))
        self.buffer.write(media + b"\0" * (-len(media) % BLOCK))
        # digests are remembered for the shard being written and the ones before it in this task, by 32 bytes each
        self.seen[digest] = place
        if self.buffer.tell() >= SHARD_BYTES:
            self.close()
        return place

    def close(self) -> None:
        if self.buffer.tell():
            fs, base = open_fs(self.folder)
            fs.create_dir(base, recursive=True)
            with fs.open_output_stream(posixpath.join(base, self.name)) as out:
                out.write(self.buffer.getbuffer())
                out.write(b"\0" * (2 * BLOCK))
            self.buffer, self.number = io.BytesIO(), self.number + 1


PLACE = "payload_sha256 binary, shard string, media_offset bigint, media_length bigint"


def store_payloads(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards; a row for each document: id, n_bytes, payload_sha256 and the place that its task wrote."""
    kind = dict(docs.dtypes)[id_col]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = ShardWriter(folder, TaskContext.get().partitionId())
        names = ["doc_id", "n_bytes", "payload_sha256", "shard", "media_offset", "media_length"]
        for batch in it:
            rows = []
            for text in batch.column(1).to_pylist():
                data = text.encode() if text else b""
                payload = padded(data)
                digest = hashlib.sha256(payload).digest()
                rows.append((len(data), digest, *shards.put(digest, payload)))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)
        shards.close()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return materialise(rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, {PLACE}"), "media-rows")


def canonical_places(rows: DataFrame) -> DataFrame:
    """One place for each digest: the first by shard and offset."""
    best = F.min(F.struct("shard", "media_offset", "media_length")).alias("p")
    return rows.groupBy("payload_sha256").agg(best).select("payload_sha256", "p.*")


def read_media(places: DataFrame, folder: str) -> DataFrame:
    """Header metadata and features for each place, shard by shard, by range reads."""
    out = "payload_sha256 binary, width int, height int, payload_bytes bigint, tail_crc32 bigint, media_bytes bigint, media_sha256 binary, feature string, shard string, media_offset bigint"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        name, file = None, None
        for batch in it:
            rows = []
            for digest, shard, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != name:
                    if file:
                        file.close()
                    name, file = shard, fs.open_input_file(posixpath.join(base, shard))
                width, height, _ = read_header(file.read_at(HEADER_BYTES, offset))
                media = file.read_at(length, offset)
                samples = decode_image(media)
                if hashlib.sha256(samples).digest() != digest:
                    raise ValueError(f"payload {digest.hex()} in {shard} doesn't have its digest")
                rows.append((digest, width, height, len(samples), zlib.crc32(samples[-16:]), len(media), hashlib.sha256(media).digest(), features(samples), shard, offset))
            cols = list(zip(*rows, strict=True)) or [[]] * 10
            kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in out.split(", ")])
        if file:
            file.close()

    ranged = places.select("payload_sha256", "shard", "media_offset", "media_length")
    # a shard's members stay together and in order, so that a file is opened once and read forward
    return ranged.repartition("shard").sortWithinPartitions("shard", "media_offset").mapInArrow(run, out)


def _hex(name: str) -> Column:
    return F.lower(F.hex(name)).alias(name)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """One row per document: sizes, digests and feature of its stored media, and where that lies."""
    folder = folder or shared_dir(docs.sparkSession, "media")
    rows = store_payloads(docs, folder, id_col, text_col)
    read = read_media(canonical_places(rows), folder)
    mine = rows.select("doc_id", "n_bytes", "payload_sha256").join(read, "payload_sha256")
    return mine.select(
        F.col("doc_id").alias(id_col), "n_bytes", "payload_bytes", _hex("payload_sha256"), "tail_crc32", "media_bytes", _hex("media_sha256"), "feature",
        "width", "height", F.concat_ws("/", F.lit(folder), "shard").alias("shard"), "media_offset",
    )
