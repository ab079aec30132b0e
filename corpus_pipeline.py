"""From raw documents to packed training sequences: each stage reads what the stage before it wrote.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last
return the columns of documents.  A document that a stage rejects is gone for
the stages after it; texts that a stage changes stay changed.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import mixing, nearcopies, packing, pii, simhash, toxicity
from attestry.llm.common import DOCUMENT, small_batches, table
from attestry.session import safe_unions, scratch_path, ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the cut go.  Null and empty texts have no toxic passage and stay, rows that repeat an
    id are scored row by row; extra columns are dropped, in this stage and all after it; an empty table stays empty."""
    small_batches(spark)
    return toxicity.without_toxic(docs.select(*DOCUMENT), table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id (of rows that repeat it, one).

    SimHash, as in op4, links fingerprints within three bits of 64.  That does not reach five-word Jaccard 0.8, so banded min-hashes find
    further candidates, whose whole sets decide; a group is what both kinds of links connect.  Texts without words are copies of each
    other; rows without an id stay."""
    small_batches(spark)
    return nearcopies.one_of_each(docs.select(*DOCUMENT), bits=simhash.SimHashParams())


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts, whatever words stand before it, is replaced by its kind; the length follows.
    Null texts stay null with the length they had; rows are neither dropped nor merged."""
    clean = pii.redact_all(docs.select(*DOCUMENT))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*DOCUMENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, at most three times; texts without words are not taken.  Ties of the random
    order are broken by id; a null source is a source."""
    return mixing.repeated(docs.select(*DOCUMENT))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mixed documents in power-of-two pieces; null and empty texts give the end id alone, every row its own pieces."""
    return packing.pack(docs, packing.PackParams(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("pii", redact_personal_data), ("mixing", mix_sources), ("packing", pack_sequences)]

#: tokenizer ids and fitted scores are beyond SQL: tests/llm/test_pipeline.py holds the stages against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again by the next."""
    ship_package(spark)
    safe_unions(spark)
    docs, folder = table(spark, sf_dir, "documents"), scratch_path(spark, "corpus")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
