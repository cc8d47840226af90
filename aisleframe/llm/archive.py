"""Content-addressed web archive.

Payload bytes are stored once under their SHA-256, checked against SHA-1 and length; the exact WARC header
of each record is kept in a table of its own. Reading joins the two back into records, and what the archive
says of a record is taken from the bytes of that record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payloads below this many bytes are never replaced by a revisit record.
LEAST_BYTES = 1000
BREAK = "\r\n"
#: Records of one payload that a task rebuilds, about; more are dealt over several parts.
COPIES = 2000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> None:
    """Write payloads/ and headers/ below the folder, one WARC record for each row.

    Of records with equal payloads of at least 1000 bytes that with the largest id is the response and the
    others revisit it; smaller ones are all responses. A null payload is empty. Rows that repeat the largest
    id are responses too; rows without an id revisit like others, and are responses where no row of the
    payload has an id. Different payloads under one SHA-256 are an error. `date` is the capture time in the
    headers, as pages have none; line breaks of an address are percent-encoded.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.expr("X''")).alias("payload"))
    rows = rows.withColumns({"key": F.sha2("payload", 256), "sha1": F.sha1("payload"),
                             "bytes": F.octet_length("payload").cast("long")})
    stored = rows.groupBy("key").agg(
        F.expr("""if(min(sha1) <> max(sha1) or min(bytes) <> max(bytes),
                     cast(raise_error('two payloads under one SHA-256') as binary), first(payload))""").alias("payload"), F.count(F.lit(1)).alias("copies"))
    stored.write.mode("overwrite").parquet(f"{folder}/payloads")

    slim = rows.select("id", "url", "key", "sha1", "bytes")
    heads = slim.groupBy("key").agg(F.max("id").alias("head"), F.count(F.lit(1)).alias("copies"))
    joined = slim.join(heads, "key")
    revisit = (F.col("bytes") >= LEAST_BYTES) & F.col("head").isNotNull() & ~F.col("id").eqNullSafe(F.col("head"))

    def name(column):
        return F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(column).cast("string"), F.lit("none")), F.lit(">"))

    header = F.concat(
        F.lit(f"WARC/1.1{BREAK}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{BREAK}WARC-Record-ID: "), name("id"),
        F.lit(f"{BREAK}WARC-Target-URI: "),
        F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")),
        F.lit(f"{BREAK}WARC-Date: {date}"),
        F.lit(f"{BREAK}WARC-Payload-Digest: sha1:"), F.col("sha1"),
        F.when(revisit, F.concat(
            F.lit(f"{BREAK}WARC-Profile: {PROFILE}{BREAK}WARC-Refers-To: "), name("head"))).otherwise(""),
        F.lit(f"{BREAK}Content-Length: "), F.when(revisit, "0").otherwise(F.col("bytes").cast("string")),
        F.lit(BREAK * 2))
    part = F.floor(F.rand(7) * (F.floor(F.col("copies") / COPIES) + 1)).cast("int")
    joined.select("id", "key", part.alias("part"), header.alias("header")).write.mode("overwrite").parquet(
        f"{folder}/headers")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """The records as bytes: page_id, key, payload (also of revisits) and record (header, block, two line breaks).

    A payload with very many records is joined in parts, so that no task rebuilds all of them. The payload
    of a header without one is null.
    """
    payloads = spark.read.schema("key string, payload binary, copies long").parquet(f"{folder}/payloads")
    payloads = payloads.select("key", "payload", F.explode(
        F.sequence(F.lit(0), F.floor(F.col("copies") / COPIES).cast("int"))).alias("part"))
    headers = spark.read.schema("id long, key string, part int, header string").parquet(f"{folder}/headers")
    block = F.when(_field("header", "WARC-Type") == "response", F.col("payload")).otherwise(F.expr("X''"))
    return headers.join(payloads, ["key", "part"], "left").select(
        F.col("id").alias("page_id"), "key", "payload",
        F.concat(F.encode("header", "UTF-8"), block, F.encode(F.lit(BREAK * 2), "UTF-8")).alias("record"))


def _field(header: str, name: str):
    return F.regexp_extract(header, rf"\r\n{name}: ([^\r]*)(?:\r\n|$)", 1)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """What the rebuilt records say: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Each record is cut into header and block at its first empty line. Length and digest are measured on the
    block of a response, and on the payload a revisit refers to. A record is an error whose payload is missing
    or has another digest, strong digest or length than stated, or whose end is not two line breaks.
    """
    records = read_records(spark, folder)
    said = F.substring_index(F.col("record").cast("string"), BREAK * 2, 1)
    cut = records.select("page_id", "key", "payload", "record", said.alias("said"))
    cut = cut.select(
        "key", "payload", F.octet_length("said").alias("n_said"), "record",
        F.regexp_extract(_field("said", "WARC-Record-ID"), "([0-9-]+)>", 1).alias("page"),
        _field("said", "WARC-Payload-Digest").alias("digest"), _field("said", "WARC-Type").alias("record_type"),
        _field("said", "Content-Length").cast("long").alias("length"),
        F.regexp_extract(_field("said", "WARC-Refers-To"), "([0-9-]+)>", 1).alias("refers"))
    block = F.expr("substring(record, n_said + 5, cast(length as int))")
    whole = cut.withColumn("whole", F.when(F.col("record_type") == "response", block).otherwise(F.col("payload")))
    whole = whole.withColumn("sha1", F.sha1("whole"))
    sound = F.expr("digest <=> concat('sha1:', sha1) AND sha2(whole, 256) <=> key "
                   "AND octet_length(record) <=> n_said + 8 + length AND substring(record, -4, 4) <=> X'0D0A0D0A'")
    return whole.select(
        F.expr("cast(nullif(page, '') as long)").alias("page_id"),
        F.octet_length("whole").cast("long").alias("payload_bytes"),
        F.when(sound, F.col("sha1")).otherwise(
            F.raise_error(F.lit("a stored payload is missing or damaged"))).alias("payload_digest"),
        "record_type", F.expr("cast(nullif(refers, '') as long)").alias("refers_to"))
