import hashlib

import pytest
from pyspark.sql import functions as F

from attestry.llm.warc import fields, read, record_bytes, write
from attestry.session import scratch_path

BIG, OTHER = "<html>" + "é" * 100, "x" * 1_000_000
PAGES = [(5, "http://a/1", BIG), (3, "http://a/2", BIG), (9, None, BIG), (3, "http://a/2", BIG), (1, "u\r\nWARC-Type: revisit", "short"), (2, "u", "short"), (7, "u", None),
         (8, "u", ""), (10, "u", OTHER), (11, "u", OTHER), (None, "u", BIG), (12, "u", "WARC/1.1\r\n\r\nX-Page-Id: 77\r\n\r\n"), (13, "u", "y" * 100), (14, "u", "y" * 99), (15, "u", "y" * 99)]


def test_round_trip(spark):
    df = spark.createDataFrame([(*p, "d", "r") for p in PAGES], "page_id long, url string, html string, digest string, record_type string").repartition(3)
    path = scratch_path(spark, "warc")
    write(df, path)
    records = read(spark, path)
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in fields(records).collect())
    first, want = {}, []
    for i, _, html in sorted(PAGES, key=lambda p: (p[0] is None, p[0] or 0)):
        data = (html or "").encode()
        name = hashlib.sha256(data).hexdigest()
        head = first.setdefault(name, i) if len(data) >= 100 else None
        again = head is not None and head != i
        want.append((str(i), len(data), name, "revisit" if again else "response", str(head if again else None)))
    assert got == sorted(want)
    assert spark.read.parquet(f"{path}/payloads").count() == len({(h or "").encode() for *_, h in PAGES})      # each content once
    whole = [bytes(r[0]) for r in records.select(record_bytes(records)).collect()]
    assert all(w.startswith(b"WARC/1.1\r\n") and w.endswith(b"\r\n\r\n") for w in whole)
    for w in whole:
        head, _, rest = w.partition(b"\r\n\r\n")
        assert len(rest) - 4 == int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])


def test_empty_and_damaged(spark):
    path = scratch_path(spark, "warc")
    write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert fields(read(spark, path)).collect() == []
    path = scratch_path(spark, "warc")
    write(spark.createDataFrame([(1, "u", BIG)], "page_id long, url string, html string"), path)
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"other")).write.parquet(f"{path}x/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}x/headers")
    with pytest.raises(Exception, match="damaged"):
        fields(read(spark, f"{path}x")).collect()
