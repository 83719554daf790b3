"""A content-addressed WARC archive.

Payload bytes are stored once under their SHA-256; record headers are stored as written, a row a
record; records are put together again by joining the two.  The digest is verified when storing
(payloads under one SHA-256 must agree in SHA-1 and length) and when reading (it is computed anew).
The pages of a common payload are spread over many tasks in both joins.  `write_warc_files` makes
compressed WARC files of records.

A response's block is a plain HTTP header and the payload; a revisit's is empty.  A record's id is
made of its page_id.

Defined results: a null html is an empty payload; a null url leaves out the target header; a null
page_id is never the record that others refer to unless its payload has no other; repeated rows
with the smallest page_id are all responses (and records of repeated page_ids repeat their ids); very
long texts are payloads like others; other columns, whatever their names, are ignored; an empty table
gives an empty archive.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, maybe_among, shared_dir

#: Payloads of fewer bytes are never revisited.
MIN_BYTES = 0
#: A payload of more pages than this is common: its pages meet it in SPREAD places.
COMMON = 1000
SPREAD = 256
RECORD_DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hex_digits: Column, length: int = 40) -> Column:
    """RFC 4648 base32 of hex digits, whose number is a multiple of 5: 5 digits are 4 characters."""
    out = []
    for at in range(1, length, 5):
        bits = F.conv(F.substring(hex_digits, at, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            out.append(F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*out)


def _place(common: Column) -> Column:
    """Where a row meets its payload: one of SPREAD places for common payloads."""
    return F.when(common, F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD))).otherwise(F.lit(0)).cast("int")


def _places(common: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), F.when(common, F.lit(SPREAD - 1)).otherwise(F.lit(0))))


def record_headers(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """pages: (page_id, url, html).  Per record: page_id, sha256 of its payload, the place where it
    meets that, and its header (with the HTTP header of a response)."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", F.sha2(payload, 256).alias("sha256"), F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("bytes"))
    firsts = rows.groupBy("sha256").agg(F.min("page_id").alias("first_id"), F.count("*").alias("many"), F.min("sha1").alias("_a"), F.max("sha1").alias("_b"), F.min("bytes").alias("_c"), F.max("bytes").alias("_d"))
    same = (F.col("_a") == F.col("_b")) & (F.col("_c") == F.col("_d"))
    firsts = firsts.select("sha256", "many", F.when(same, F.col("first_id")).otherwise(F.raise_error(F.lit("two payloads have one SHA-256"))).alias("first_id"))
    firsts = Scratch(pages.sparkSession).table(firsts, "digests")
    # both sides take the same view of which payloads are common, so a few taken for such do no harm
    common = firsts.filter(F.col("many") > COMMON).select("sha256")
    rows = maybe_among(rows, F.col("sha256"), common, "common").withColumn("at", _place(F.col("common"))).drop("common")
    firsts = maybe_among(firsts, F.col("sha256"), common, "common").select("sha256", "many", "first_id", _places(F.col("common")).alias("at"))
    rows = rows.join(firsts, ["sha256", "at"])
    revisit = (F.col("bytes") >= min_bytes) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))

    def line(name: str, value: Column | str) -> Column:
        return F.concat(F.lit(name + ": "), F.lit(value) if isinstance(value, str) else value, F.lit("\r\n"))

    def record_id(c: str) -> Column:
        return F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), line("Content-Type", "text/html; charset=utf-8"), line("Content-Length", F.col("bytes").cast("string")), F.lit("\r\n"))
    http = F.when(revisit, F.lit("")).otherwise(http)
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id("page_id")),
        line("WARC-Date", RECORD_DATE),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        F.when(revisit, F.concat(line("WARC-Profile", PROFILE), line("WARC-Refers-To", record_id("first_id")))).otherwise(F.lit("")),
        line("Content-Type", "application/http; msgtype=response"),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("bytes") + F.octet_length(http)).cast("string")),
        F.lit("\r\n"),
        http,
    )
    return rows.select("page_id", "sha256", _place(F.col("many") > COMMON).alias("at"), F.encode(header, "UTF-8").alias("header"))


def write_archive(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> None:
    """Writes path/headers and path/payloads."""
    record_headers(pages, min_bytes).write.parquet(f"{path}/headers")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    payloads = pages.select(F.sha2(payload, 256).alias("sha256"), payload.alias("payload"))
    payloads.groupBy("sha256").agg(F.first("payload").alias("payload"), F.count("*").alias("many")).write.parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The archive's records: page_id, header, full payload and the record's exact bytes (a revisit
    record's block is empty)."""
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    sound = F.sha2("payload", 256) == F.col("sha256")
    payloads = payloads.withColumn("payload", F.when(sound, F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload is damaged")).cast("binary")))
    payloads = payloads.select("sha256", "payload", _places(F.col("many") > COMMON).alias("at"))
    revisit = F.decode("header", "UTF-8").startswith("WARC/1.1\r\nWARC-Type: revisit\r\n")
    block = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    return headers.join(payloads, ["sha256", "at"]).select("page_id", "header", "payload", F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"))


def write_warc_files(records: DataFrame, path: str) -> DataFrame:
    """Writes a .warc.gz file a task below path (a URI, or a folder that all executors share), each
    record compressed by itself, and their list as the table path/files: name, records and bytes.
    Files that aren't in the list come from tasks that were lost and did their work again."""
    spark = records.sparkSession

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        task, count, size = TaskContext.get(), 0, 0
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root)
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in batches:
                for record in batch.column("record"):
                    data = gzip.compress(record.as_py(), mtime=0)
                    out.write(data)
                    count, size = count + 1, size + len(data)
        yield pa.RecordBatch.from_pydict({"name": [name], "records": [count], "bytes": [size]})

    records.select("record").mapInArrow(work, "name string, records long, bytes long").write.parquet(f"{path}/files")
    return spark.read.parquet(f"{path}/files")


def parsed(records: DataFrame) -> DataFrame:
    """Fields of the records' headers, checked against the payloads."""
    text = F.decode("header", "UTF-8")

    def field(name: str) -> Column:
        return F.regexp_extract(text, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)

    digest = base32(F.sha1("payload"))
    refers = F.nullif(F.regexp_extract(field("WARC-Refers-To"), r"<urn:x-page:(.*)>", 1), F.lit(""))
    return records.select(
        "page_id",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), digest), digest).otherwise(F.raise_error(F.lit("a header's digest is not its payload's"))).alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        refers.cast(records.schema["page_id"].dataType).alias("refers_to"),
        F.octet_length("record").cast("long").alias("record_bytes"),
    )


def op8_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(pages, path)
    return parsed(read_archive(spark, path)).drop("record_bytes")


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM q
"""
