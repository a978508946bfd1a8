"""Content-addressed web archives.

Every record keeps its exact header bytes. Payload bytes are stored once for each strong digest, compressed, and the
digest is verified twice: when records are written, all payloads of one digest must agree in a second, independent
digest and in length; when they are read, the stored bytes must give the digest again. Records come back by joining
headers with payloads. Of records with equal payloads of at least MIN_REVISIT bytes, the one with the largest id is
the response and the others are revisits of it.

Defined results: a null payload counts as empty; a null url is written as an empty target; control characters in a url
are percent-encoded (others than line ends as %20); rows that repeat an id give as many records, and where the largest id repeats each of them is a
response; an empty table gives empty archives.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ssaflow.llm.common import materialise, shared_dir

#: Payloads below so many bytes are never replaced by a revisit.
MIN_REVISIT = 1000
#: Ends a header line and, twice, a record.
CRLF = "\r\n"
#: Fixed value: the profile that revisits by equal payload name.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    """Where an archive's two tables lie."""

    headers: str
    payloads: str


#: Stands for a null id.
NO_ID = -(1 << 63)


def _digests(pages: DataFrame, packed: bool) -> DataFrame:
    """page_id, url, and of the payload: sha256, sha1, md5 and length; or instead page_id, sha256 and the compressed bytes."""
    if packed:
        names, kinds, schema = ["page_id", "sha256", "packed"], [pa.string(), pa.binary()], "page_id bigint, sha256 string, packed binary"
    else:
        names, kinds = ["page_id", "url", "sha256", "sha1", "md5", "payload_bytes"], [pa.string(), pa.string(), pa.string(), pa.int64()]
        schema = "page_id bigint, url string, sha256 string, sha1 string, md5 string, payload_bytes bigint"

    def told(data: bytes) -> tuple:
        digest = hashlib.sha256(data).hexdigest()
        return (digest, gzip.compress(data, 6, mtime=0)) if packed else (digest, hashlib.sha1(data).hexdigest(), hashlib.md5(data).hexdigest(), len(data))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [told(text.encode() if text else b"") for text in batch.column(2).to_pylist()]
            cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            made = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *([] if packed else [batch.column(1)]), *made], names)

    return pages.mapInArrow(run, schema)


def _uri(url: Column) -> Column:
    """The target without characters that would end a header line."""
    safe = F.coalesce(url, F.lit(""))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(safe, "\r", "%0D"), "\n", "%0A"), r"[\x00-\x1f\x7f]", "%20")


def _header(kind: Column, refers_to: Column) -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    revisit = kind == "revisit"
    text = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Target-URI", _uri(F.col("url"))),
        line("WARC-Date", F.lit("2000-01-01T00:00:00Z")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), refers_to.cast("string"), F.lit(">"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit(CRLF),
    )
    return F.encode(text, "UTF-8")


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", folder: str | None = None) -> Archive:
    """Write the header and payload tables of an archive with one record per row."""
    folder = folder or shared_dir(pages.sparkSession, "warc")
    named = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.col(payload_col).alias("html"))
    rows = materialise(_digests(named, packed=False), "warc-rows")
    # one small row for each payload: who keeps it, and whether all that have its digest agree
    same = (F.min("md5") == F.max("md5")) & (F.min("payload_bytes") == F.max("payload_bytes"))
    owners = rows.groupBy("sha256").agg(F.max(F.coalesce("page_id", F.lit(NO_ID))).alias("owner"), F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("two payloads have one digest"))).alias("verified"))
    headers = rows.drop("md5").join(owners, "sha256").where("verified")
    revisits = (F.col("payload_bytes") >= MIN_REVISIT) & F.col("page_id").isNotNull() & (F.col("page_id") < F.col("owner"))
    kind = F.when(revisits, F.lit("revisit")).otherwise(F.lit("response"))
    archive = Archive(f"{folder}/headers", f"{folder}/payloads")
    headers.select("sha256", _header(kind, F.col("owner")).alias("header")).write.parquet(archive.headers)
    # bytes are read again, and move once: with the row that keeps them, by keys that only repeated rows share
    bytes_of = _digests(named, packed=True).withColumn("owner", F.coalesce("page_id", F.lit(NO_ID))).drop("page_id")
    kept = bytes_of.join(owners.select("sha256", "owner"), ["sha256", "owner"], "left_semi").dropDuplicates(["sha256", "owner"])
    kept.select("sha256", "packed").write.parquet(archive.payloads)
    return archive


def _field(name: str) -> Column:
    return F.regexp_extract(F.decode("header", "UTF-8"), rf"(?m)^{name}: ([^\r\n]*)", 1)


def read_headers(spark: SparkSession, archive: Archive) -> DataFrame:
    """The records' header bytes and what they say."""
    number = lambda name: F.nullif(F.regexp_extract(_field(name), r"^<urn:page:(-?\d+)>$", 1), F.lit("")).cast("bigint")
    return spark.read.schema("sha256 string, header binary").parquet(archive.headers).select(
        "sha256", "header", _field("WARC-Type").alias("record_type"), number("WARC-Record-ID").alias("page_id"),
        number("WARC-Refers-To").alias("refers_to"), F.substring_index(_field("WARC-Payload-Digest"), ":", -1).alias("declared_digest"),
    )


def _unpacked(payloads: DataFrame, schema: str, columns) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = []
            for digest, packed in zip(batch.column("sha256").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                data = gzip.decompress(packed)
                if hashlib.sha256(data).hexdigest() != digest:
                    raise ValueError(f"stored payload {digest} doesn't have its digest")
                out.append((digest, *columns(data)))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], pa.schema(list(zip(names, kinds, strict=True))))

    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]
    return payloads.mapInArrow(run, schema)


def read_payloads(spark: SparkSession, archive: Archive) -> DataFrame:
    """sha256 and the verified payload bytes."""
    return _unpacked(spark.read.schema("sha256 string, packed binary").parquet(archive.payloads), "sha256 string, payload binary", lambda data: (data,))


def read_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """The original records: header, payload (a revisit's is the one it refers to) and the record's exact bytes."""
    end = F.encode(F.lit(CRLF * 2), "UTF-8")
    joined = read_headers(spark, archive).join(read_payloads(spark, archive), "sha256")
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return joined.withColumn("record", F.concat("header", body, end))


def read_summaries(spark: SparkSession, archive: Archive) -> DataFrame:
    """For each record what its header says and the size and digest of its payload as stored, without moving payloads."""
    stored = spark.read.schema("sha256 string, packed binary").parquet(archive.payloads)
    sums = _unpacked(stored, "sha256 string, payload_bytes bigint, payload_digest string", lambda data: (len(data), hashlib.sha1(data).hexdigest()))
    joined = read_headers(spark, archive).join(sums, "sha256")
    same = F.when(F.col("declared_digest") == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a header's digest isn't its payload's")))
    return joined.select("page_id", "payload_bytes", same.alias("payload_digest"), "record_type", "refers_to")
