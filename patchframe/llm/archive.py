"""Content-addressed web archive of captured documents.

Payload bytes are stored once under a verified digest, the exact record headers
separately; a join puts the original records together again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path

CRLF = "\r\n"


def write_archive(captures: DataFrame, folder: str | None = None, id: str = "capture_id", uri: str = "uri",
                  body: str = "body", revisit_bytes: int = 1000) -> str:
    """Write one WARC record per capture under ``folder``; returns the folder.

    The project has no web captures of its own, so this is general: any document with
    an integer id, an address and a text body (a GeoJSON sidecar, an exported map).

    payloads/  sha256, payload      each distinct payload once
    headers/   capture id, sha256, header   exact header block, up to its blank line

    Of records with equal payloads of ``revisit_bytes`` or more the one with the
    largest id is ``response``, the others are ``revisit`` and refer to it; smaller
    payloads are all ``response``.  Rows that share the largest id are all responses.
    A null body is an empty payload; null ids sort below all others.  Line ends in an
    address are percent-encoded, a null address is left out.  Other columns do not
    matter.  Only ids and digests are joined for the headers, and the digest of a
    payload that many captures share is one row there, so no payload piles up.
    """
    spark = captures.sparkSession
    folder = folder or new_path(spark, "warc")
    C = captures.select(
        F.col(id).cast("long").alias("id"), F.col(uri).cast("string").alias("uri"), F.encode(F.coalesce(F.col(body), F.lit("")), "UTF-8").alias("payload"),
    )
    C = C.withColumn("sha256", F.sha2("payload", 256)).withColumn("key", F.coalesce("id", F.lit(-(2**63))))
    N = C.select("id", "key", "uri", "sha256", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("n"))
    holders = N.groupBy("sha256").agg(F.max("key").alias("holder"))
    H = N.join(holders, "sha256")
    again = (F.col("n") >= revisit_bytes) & (F.col("key") != F.col("holder"))
    name = lambda c: F.concat(F.lit("<urn:capture:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    address = F.replace(F.replace(F.col("uri"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat_ws(
        CRLF,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("id"))),
        F.concat(F.lit("WARC-Target-URI: "), address),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), name(F.col("holder")))),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(again, 0).otherwise(F.col("n")).cast("string")),
        F.lit(CRLF),
    )
    H.select("id", "sha256", header.alias("header")).write.parquet(f"{folder}/headers")
    # Payloads travel by digest and id, so one that many captures share is spread; equal rows meet without another exchange.
    held = holders.select("sha256", F.col("holder").alias("key"))
    C.join(held, ["sha256", "key"]).groupBy("sha256", "key").agg(F.any_value("payload").alias("payload")).select(
        "sha256", "payload").write.parquet(f"{folder}/payloads")
    return folder


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """The records of an archive: ``id, type, refers_to, uri, sha1, sha256, n_bytes, header, payload``.

    Digests and lengths are taken where a payload is read, so payloads themselves travel
    only if they are asked for.  A payload whose bytes do not give the digest it is stored under, or that is
    missing, stops the job.  ``payload`` is the full payload, for revisits too;
    ``header || body || CRLF CRLF`` with an empty body for revisits is the record.
    """
    P = spark.read.parquet(f"{folder}/payloads").select(
        F.col("sha256").alias("stored"), F.sha2("payload", 256).alias("seen"), F.sha1("payload").alias("sha1_seen"), F.octet_length("payload").cast("long").alias("n_bytes"), "payload",
    )
    field = lambda key, what="([^\r\n]*)": F.nullif(F.regexp_extract("header", f"(?:^|\n){key}: {what}", 1), F.lit(""))
    H = spark.read.parquet(f"{folder}/headers")
    R = H.join(P, F.col("sha256") == F.col("stored"), "left").withColumn("sha1", field("WARC-Payload-Digest", "sha1:([0-9a-f]+)"))
    sound = (F.col("seen") == F.col("stored")) & (F.col("sha1_seen") == F.col("sha1"))
    checked = lambda c, kind: F.when(F.coalesce(sound, F.lit(False)), F.col(c)).otherwise(
        F.raise_error(F.concat(F.lit("archive: no sound payload under "), F.col("sha256"))).cast(kind))
    R = R.withColumns({"payload": checked("payload", "binary"), "sha1": checked("sha1", "string")})
    return R.select(
        field("WARC-Record-ID", "<urn:capture:(-?\\d+)>").cast("long").alias("id"), field("WARC-Type").alias("type"),
        field("WARC-Refers-To", "<urn:capture:(-?\\d+)>").cast("long").alias("refers_to"), field("WARC-Target-URI").alias("uri"),
        "sha1", "sha256", "n_bytes", "header", "payload",
    )


def record_bytes(records: DataFrame) -> DataFrame:
    """``id, record binary``: each record as it stands in a WARC file."""
    body = F.when(F.col("type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return records.select("id", F.concat(F.encode("header", "UTF-8"), body, F.encode(F.lit(CRLF * 2), "UTF-8")).alias("record"))
