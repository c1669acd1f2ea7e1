"""Content-addressed WARC archive.

``write`` stores every distinct payload once, under its SHA-256, and every
record's exact header block in a table of its own.  ``records`` joins the two
and gives back the original records byte for byte, having verified each
payload against its address, its length and the SHA-1 of the record header.

Records with equal payloads of at least ``min_revisit`` bytes: the one with the
largest id is ``response``, the others are ``revisit`` and refer to it; all
other records are ``response``.  Payload null counts as empty.  Rows that
repeat an id are each a record with a WARC-Record-ID of its own; of those that
hold the largest id of a payload, all are ``response``, and the one with the
largest record id is referred to.  Null ids sort below all others and come back
as null.  Null uri: no target header.  Empty table: empty archive, read back
empty.  Extra columns are ignored.

The payload shuffle carries each map task's distinct payloads only (partial
aggregation), and the final join is an equi-join that AQE can split, so one
payload that fills a third of the archive is no hot task.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import discard, new_path, text_of, written

CRLF = "\r\n"


def write(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", min_revisit: int = 1000, date: str | None = None) -> str:
    """Archive a table below ``path``: payloads/ (address, payload) and records/ (address, header); ``date`` (now) is that of all records."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    body = F.encode(text_of(payload_col), "UTF-8")
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).alias("uri"), body.alias("payload"))
    base = base.withColumn("address", F.sha2("payload", 256))
    # One representative per address: a map-side combine keeps a task's copies down to one.
    base.groupBy("address").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")

    # Written, so that every record keeps the id that it was given.
    slim = written(base.select("id", "uri", "address", F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("sha1"), F.uuid().alias("rid")), "records")
    owners = slim.filter(F.col("n") >= min_revisit).groupBy("address").agg(F.max(F.struct("id", "rid")).alias("owner"), F.count("*").alias("copies")).filter("copies > 1").select("address", "owner")
    # Heads of the chain are few beside all records, so the join is by address again and AQE picks the side.
    typed = slim.join(owners, "address", "left")
    revisit = F.col("owner").isNotNull() & ~F.col("id").eqNullSafe(F.col("owner.id"))
    urn = lambda c: F.concat(F.lit("<urn:uuid:"), c, F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("rid"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("X-Page-ID", F.col("id").cast("string")), F.lit("")),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("uri", r"[\r\n]", "%0A")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.coalesce(F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("owner.rid"))), line("X-Refers-To-Page-ID", F.col("owner.id").cast("string")))), F.lit("")),
        F.when(revisit, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("X-Payload-Length", F.col("n").cast("string")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n").cast("string"))),
        F.lit(CRLF),
    )
    typed.select("address", F.encode(header, "UTF-8").alias("header")).write.parquet(f"{path}/records")
    discard(slim)
    return path


def records(spark: SparkSession, path: str) -> DataFrame:
    """Read an archive back: (id, record_type, refers_to, payload_bytes, payload_digest, header, payload).

    ``payload`` is the full payload also for a revisit.  A payload that is
    missing or does not hash to its address, to the header's digest or to its
    length fails the query.
    """
    head = spark.read.parquet(f"{path}/records")
    kept = spark.read.parquet(f"{path}/payloads")
    text = F.decode("header", "UTF-8")
    number = lambda name: F.nullif(F.regexp_extract(text, rf"(?md)^{name}: (-?[0-9]+)\r$", 1), F.lit("")).cast("long")
    checked = kept.select("address", "payload", F.sha2("payload", 256).alias("strong"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n"))
    out = head.join(checked, "address", "left")
    good = (F.col("strong") == F.col("address")) & (F.regexp_extract(text, r"(?md)^WARC-Payload-Digest: sha1:([0-9a-f]+)\r$", 1) == F.col("sha1")) & (F.regexp_extract(text, r"(?md)^X-Payload-Length: ([0-9]+)\r$", 1).cast("long") == F.col("n"))
    digest = F.when(F.coalesce(good, F.lit(False)), F.col("sha1")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("address"))))
    return out.select(
        number("X-Page-ID").alias("id"),
        F.regexp_extract(text, r"(?md)^WARC-Type: (\w+)\r$", 1).alias("record_type"),
        number("X-Refers-To-Page-ID").alias("refers_to"),
        F.col("n").alias("payload_bytes"),
        digest.alias("payload_digest"),
        "header",
        "payload",
    )


def warc_bytes(recs: DataFrame) -> DataFrame:
    """Each record as it stands in a WARC file: header, own block, two line ends."""
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return recs.select("id", F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_path(spark, "warc"))
    return records(spark, path).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT payload_digest, max(page_id) AS owner, count(*) AS copies FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
 CASE WHEN copies > 1 AND page_id IS DISTINCT FROM owner THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN copies > 1 AND page_id IS DISTINCT FROM owner THEN owner END AS refers_to
FROM p LEFT JOIN o USING (payload_digest)
"""
