"""What the operators share: table access, the shared folder, blobs and batch sizes."""

from __future__ import annotations

import ctypes
import functools
import gc
import posixpath
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ssaflow.checkpoints import materialise as materialise
from ssaflow.checkpoints import shared_root

#: A word: a run of characters other than space and \\t \\n \\v \\f \\r.
WORD_RE = "[^\\x20\\x09-\\x0D]+"

#: Rows in an Arrow batch handed to Python; texts may be long.
BATCH_ROWS = 512

#: Bytes of text that one bucket of a regrouping should hold at most, on average.
BUCKET_BYTES = 128 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batch size, so that a batch of long texts fits in a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are over: it does once the driver's JVM finds their plans
    unreachable, which may take long where the driver makes little garbage. Executors collect theirs too: only a full
    collection lets a heap that earlier jobs have stretched shrink again. The driver's Python gives back what it freed."""
    context = spark.sparkContext
    gc.collect()
    _trim()
    context._jvm.System.gc()
    if not context._jsc.sc().isLocal():
        n = context.defaultParallelism
        spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def _trim() -> None:
    """Give memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable) -> Callable:
    """A task's function for mapInArrow, in a worker that holds no memory that is free: workers are used again and
    outlive their tasks, so what earlier ones needed at most, vocabularies and batches, would stay beside the JVM."""

    @functools.wraps(run)
    def trimmed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _trim()
        yield from run(it)
        _trim()

    return trimmed


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder name below the shared one; it lives as long as its owner keeps checkpoints."""
    return f"{shared_root(spark)}/ssaflow/{tag}-{uuid.uuid4().hex}"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system that Python workers can use, and the path in it."""
    for mine, theirs in (("s3a://", "s3://"), ("s3n://", "s3://")):
        uri = theirs + uri[len(mine) :] if uri.startswith(mine) else uri
    if uri.startswith("file:") and "://" not in uri:
        uri = "file://" + uri[len("file:") :]
    return pafs.FileSystem.from_uri(uri)


def write_file(uri: str, name: str, data: bytes) -> None:
    """Write a whole file under a name that only this attempt uses, then move it into place: a retry replaces it by the same bytes."""
    fs, base = open_fs(uri)
    fs.create_dir(base, recursive=True)
    temp, final = posixpath.join(base, f".{name}.{uuid.uuid4().hex}"), posixpath.join(base, name)
    with fs.open_output_stream(temp) as out:
        out.write(data)
    fs.move(temp, final)


def read_file(uri: str, name: str) -> bytes:
    fs, base = open_fs(uri)
    with fs.open_input_file(posixpath.join(base, name)) as f:
        return f.read()


def bucket_count(df: DataFrame, text_col: str = "text") -> int:
    """Buckets for a regrouping of what comes from the texts of df: they follow the bytes counted, and spread evenly over
    the shuffle's partitions."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = df.agg(F.sum(F.octet_length(text_col).cast("bigint"))).first()[0] or 0
    return int(max(4 * partitions, size // BUCKET_BYTES + 1))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob; sorted integers should be passed as differences."""
    parts = [len(arrays).to_bytes(1, "little")]
    for a in arrays:
        raw = np.ascontiguousarray(a)
        # bytes of equal weight lie together, which compresses better
        planes = raw.view(np.uint8).reshape(raw.size, raw.itemsize).T.tobytes() if raw.size else b""
        code = raw.dtype.str[1:].encode()
        parts += [len(code).to_bytes(1, "little"), code, raw.size.to_bytes(8, "little"), planes]
    raw = b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    at, out = 1, []
    for _ in range(raw[0]):
        n = raw[at]
        kind = np.dtype("<" + raw[at + 1 : at + 1 + n].decode())
        at += 1 + n
        size = int.from_bytes(raw[at : at + 8], "little")
        at += 8
        end = at + size * kind.itemsize
        planes = np.frombuffer(raw, np.uint8, end - at, at).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind) if size else np.empty(0, kind))
        at = end
    return out


def deltas(a: np.ndarray) -> np.ndarray:
    """A sorted int64 array as its first value and differences."""
    return np.diff(a.astype(np.int64), prepend=np.int64(0))


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_blocks(data: bytes, size: int = 1 << 22) -> Iterator[list[bytes]]:
    """The words of a text in lists of bounded size; only a single word may be longer."""
    at = 0
    while len(data) - at > size:
        cut = _SPACE.search(data, at + size)
        if not cut:
            break
        yield data[at : cut.start()].split()
        at = cut.end()
    yield data[at:].split() if at else data.split()
