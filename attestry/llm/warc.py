"""A content-addressed web archive: payloads once by digest, record headers apart, records rebuilt by joins.

`write` makes two tables in a folder: `headers`, one row per record with its
exact header bytes, and `payloads`, one row per distinct content with its
SHA-256 name.  `read` joins them on the digest; a payload whose bytes no longer
have their name stops the job.  Of records with equal payloads of at least
`shared_from` bytes the one with the smallest page_id is the response and the
others are revisits of it; smaller ones are all responses.

Cases: a null html is an empty payload; a null url an empty target; line breaks
in a url are escaped; a null page_id is written as an empty field, comes after
all ids and reads back as null; rows that repeat the response's page_id are
responses too; payloads of any length are kept whole; extra columns are
ignored; an empty table gives an empty table.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.common import stored


@dataclass(frozen=True)
class WarcParams:
    shared_from: int = 100
    date: str = "1970-01-01T00:00:00Z"      # pages have no date of their own
    profile: str = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


_END = "\r\n"


def _urn(page_id: Column) -> Column:
    h = F.md5(F.coalesce(page_id.cast("string"), F.lit("")))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))


def _payload(html: Column) -> Column:
    return F.encode(F.coalesce(html, F.lit("")), "UTF-8")


def _header(p: WarcParams) -> Column:
    """Header bytes of a record; a revisit carries no payload of its own and names the record that does."""
    revisit = F.col("record_type") == "revisit"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_END))
    return F.encode(F.concat(
        F.lit("WARC/1.1" + _END), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", _urn(F.col("page_id"))),
        line("WARC-Date", F.lit(p.date)), line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", "%0A")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(p.profile)), line("WARC-Refers-To", _urn(F.col("refers_to"))),
                                 line("X-Refers-To-Page", F.col("refers_to").cast("string")))).otherwise(""),
        line("X-Page-Id", F.coalesce(F.col("page_id").cast("string"), F.lit(""))), line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))), F.lit(_END)), "UTF-8")


def write(pages: DataFrame, path: str, p: WarcParams = WarcParams()) -> None:
    content = pages.select("page_id", "url", _payload(F.col("html")).alias("payload")).withColumn("digest", F.sha2("payload", 256))
    content.select("digest", "payload").dropDuplicates(["digest"]).write.option("compression", "zstd").parquet(f"{path}/payloads")
    named = stored(content.select("page_id", "url", "digest", F.length("payload").cast("long").alias("payload_bytes")), "warc-names")
    first = named.where(F.col("payload_bytes") >= p.shared_from).groupBy("digest").agg(F.min("page_id").alias("first_id"))
    records = named.join(first, "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    records = records.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first_id")))
    records.select("digest", _header(p).alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(header, payload): every record with its full payload, a revisit's too, checked against its digest."""
    headers = spark.read.parquet(f"{path}/headers")
    payloads = spark.read.parquet(f"{path}/payloads").withColumn("sound", F.sha2("payload", 256) == F.col("digest"))
    whole = headers.join(payloads, "digest", "left")
    checked = F.when(F.coalesce("sound", F.lit(False)), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("damaged or missing payload "), F.col("digest"))).cast("binary"))
    return whole.select("header", checked.alias("payload"))


def fields(records: DataFrame, id_type: str = "long") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) from what the records say and hold."""
    text = F.decode("header", "UTF-8")
    value = lambda name: F.regexp_extract(text, rf"\n{name}: ([^\r\n]*)\r\n", 1)
    number = lambda name: F.nullif(value(name), F.lit("")).cast(id_type)
    return records.select(number("X-Page-Id").alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"),
                          F.sha2("payload", 256).alias("payload_digest"), value("WARC-Type").alias("record_type"),
                          number("X-Refers-To-Page").alias("refers_to"))


def record_bytes(records: DataFrame) -> Column:
    """The record as it stands in a WARC file: header, own payload (none for a revisit), two line ends."""
    own = F.when(F.decode("header", "UTF-8").rlike(r"\nWARC-Type: revisit\r\n"), F.lit(b"")).otherwise(F.col("payload"))
    return F.concat(F.col("header"), own, F.lit(b"\r\n\r\n"))
