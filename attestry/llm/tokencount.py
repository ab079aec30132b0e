"""Token counts through a digest cache: a text is encoded once for each tokenizer version, whoever holds it.

Contents are normalised (white space this tokenizer drops is folded) and named
by SHA-256.  The cache is a table of (version, digest, n_tokens); version is
the digest of the tokenizer file.  Documents are joined with it, the distinct
digests it lacks are encoded once, and their counts are appended.

Cases: a null or empty text has 0 bytes and the count of the empty text; texts
of any length are encoded whole; equal texts share one encoding and one cache
row; extra columns are ignored; an empty table gives an empty table.  An append
that is run again after a failure may repeat rows; reading takes them once.
"""

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.common import stored
from attestry.llm.tokens import ChunkCounter, loaded, parts, slices

CACHE_SCHEMA = "version string, digest binary, n_tokens long"


@dataclass(frozen=True)
class CountParams:
    tokenizer: str              # a file whose tokenizer folds white space and case
    limit: int = 2048


def version_of(path: str) -> str:
    return hashlib.sha256(open(path, "rb").read()).hexdigest()


def normalised(text: Column) -> Column:
    """Runs of white space become one space, none at the ends; a null text is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\r\n]{2,}|[\t\r\n]", " "))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer version; a folder that nothing was written to yet is empty."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    rows = spark.read.schema(CACHE_SCHEMA).parquet(path) if there else spark.createDataFrame([], CACHE_SCHEMA)
    return rows.where(F.col("version") == version).groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))


def encode_missing(docs: DataFrame, cache: str, p: CountParams) -> None:
    """Append the counts of the distinct contents that the cache lacks."""
    spark, version, path = docs.sparkSession, version_of(p.tokenizer), p.tokenizer
    contents = docs.select(normalised(F.col("text")).alias("content")).withColumn("digest", _digest(F.col("content")))
    missing = contents.join(read_cache(spark, cache, version), "digest", "left_anti").dropDuplicates(["digest"])

    def count(batches):
        counter = loaded(ChunkCounter, path)
        for batch in parts(batches):
            texts = batch.column(1).to_pylist()
            counts = [n for a, b in slices(texts) for n in counter.counts(texts[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    counted = missing.select("digest", "content").mapInArrow(count, "digest binary, n_tokens long")
    counted.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)


def count_tokens(docs: DataFrame, cache: str, p: CountParams) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit); `cache` is a folder every executor can reach."""
    named = stored(docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
                               _digest(normalised(F.col("text"))).alias("digest")), "token-digests")
    encode_missing(docs, cache, p)
    counts = read_cache(docs.sparkSession, cache, version_of(p.tokenizer))
    return named.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > p.limit).alias("over_limit"))
