"""Content-addressed WARC archive.

The archive is two tables.  ``blobs`` holds every distinct payload once, under
its SHA-256; ``headers`` holds the exact header bytes of every record and the
digest of its payload.  Records are rebuilt by a join on the digest.

One payload is stored per digest after a partial aggregate, so a payload that a
third of all pages share is reduced before it is shuffled.  The digest is
verified on writing (length and SHA-1 of all payloads under a digest must
agree) and on reading (the stored bytes must hash to their address).

Of equal payloads the largest page id is the ``response``; the others are
``revisit`` records that refer to it.  Null html is an empty payload, null urls
give an empty target.  Rows with equal page id and payload are records of their
own; all that carry the largest id are responses.  A null page id is never the
largest unless there is no other; then its rows are responses with an empty id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerfold.session import scratch_dir

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2026-01-01T00:00:00Z"


def base32(hex_digest: Column) -> Column:
    """Base32 of a hex SHA-1 (160 bits are 32 digits without padding)."""
    digits = []
    for part in range(4):
        bits = F.conv(F.substring(hex_digest, part * 10 + 1, 10), 16, 10).cast("long")
        for k in range(8):
            value = F.shiftright(bits, 35 - 5 * k).bitwiseAND(F.lit(31))
            digits.append(F.substring(F.lit(BASE32), (value + 1).cast("int"), F.lit(1)))
    return F.concat(*digits)


def record_id(page: Column, digest: Column) -> Column:
    """UUID-shaped record id from page id and payload digest."""
    h = F.sha2(F.concat_ws("/", page, digest), 256)
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3),
                    F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def write_archive(pages: DataFrame, path: str, *, page: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0,
                  date: str = DATE) -> None:
    """Write ``blobs`` and ``headers`` of one record per row below ``path``."""
    spark = pages.sparkSession
    src = pages.select(F.col(page).alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"),
                       F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    src = src.withColumn("address", F.sha2("payload", 256))
    sha1, size = F.sha1("payload"), F.octet_length("payload").cast("long")
    blobs = src.groupBy("address").agg(
        F.max("page_id").alias("holder"), F.first("payload").alias("payload"), F.min(sha1).alias("sha1"), F.max(sha1).alias("_sha1"),
        F.min(size).alias("n_bytes"), F.max(size).alias("_bytes"))
    same = (F.col("sha1") == F.col("_sha1")) & (F.col("n_bytes") == F.col("_bytes"))
    checked = F.when(same, F.col("payload")).otherwise(F.raise_error(F.lit("two payloads under one digest")).cast("binary"))
    blobs.select("address", "holder", "sha1", "n_bytes", checked.alias("payload")).write.option("compression", "zstd").parquet(f"{path}/blobs")
    stored = spark.read.parquet(f"{path}/blobs").select("address", "holder", "sha1", "n_bytes")
    rows = src.select("page_id", "url", "address").join(stored, "address")
    own, holder = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("page_id", "holder"))
    revisit = (F.col("n_bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("holder"))
    digest = base32(F.col("sha1"))
    line = F.lit("\r\n")
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), line,
        F.lit("WARC-Record-ID: "), record_id(own, F.col("address")), line,
        F.lit(f"WARC-Date: {date}\r\nWARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", ""), line,
        F.lit("WARC-Payload-Digest: sha1:"), digest, line,
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_id(holder, F.col("address")), line,
                                 F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))).otherwise(""),
        F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes")).cast("string"),
        F.lit("\r\n\r\n"))
    rows.select("page_id", F.col("address"), F.when(revisit, F.col("holder")).alias("refers_to"), F.encode(header, "UTF-8").alias("header")).write.option(
        "compression", "zstd").parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of an archive: page_id, header, refers_to, payload, payload_bytes and payload_digest.

    The address of every blob is recomputed from its stored bytes; a payload
    that does not match fails the read.  Columns that are not asked for, the
    payload above all, are pruned before the join.
    """
    blobs = spark.read.parquet(f"{path}/blobs")
    sound = F.sha2("payload", 256) == F.col("address")
    digest = F.when(sound, F.sha1("payload")).otherwise(F.raise_error(F.lit("stored payload does not match its digest")).cast("string"))
    blobs = blobs.select("address", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), base32(digest).alias("payload_digest"))
    return spark.read.parquet(f"{path}/headers").join(blobs, "address")


def records(archive: DataFrame) -> DataFrame:
    """Full bytes of every record: header, block and the two closing line ends.

    A revisit has an empty block; its payload comes from the record it refers to.
    """
    block = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b""))
    return archive.select("page_id", F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"), "payload")


def header_field(name: str) -> Column:
    """Value of a field of the stored header."""
    return F.regexp_extract(F.decode("header", "UTF-8"), rf"(?m)^{name}: ([^\r\n]*)", 1)


def archive_path(spark: SparkSession) -> str:
    """A new folder for an archive in the shared scratch folder."""
    return f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
