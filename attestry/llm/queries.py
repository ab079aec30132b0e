"""The registered queries of the text operators: each applies one to its whole table with production parameters."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from attestry.llm import langid, lattice, merkle, mixing, packing, pii, runs, search, simhash, tokencount, tokenfiles, toxicity, warc
from attestry.llm.common import table
from attestry.llm.sql import ORACLES as SQL
from attestry.session import safe_unions, scratch_path, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = dict(SQL)


def query(fn: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        safe_unions(spark)
        return fn(spark, folder)

    QUERIES[fn.__name__] = run
    return fn


@query
def op1_pii(spark, folder):
    found = pii.find(table(spark, folder, "documents"))
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(spans, lambda s: s["kind"].isin(*pii.BASE))
    return found.select("doc_id", *[count(k) for k in pii.BASE], F.sha2(pii.digest(base), 256).alias("base_sha256"), pii.digest(spans).alias("spans"),
                        F.size(spans).cast("long").alias("n_spans"), pii.scores(spans).alias("scores_milli"))


@query
def op2_mixing(spark, folder):
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.col("source_target").alias("target"), (F.col("times") * F.col("size")).alias("taken"))


@query
def op3_packing(spark, folder):
    p = packing.PackParams(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(table(spark, folder, "documents"), p, with_ids=False)


@query
def op4_simhash(spark, folder):
    groups = simhash.near_duplicates(table(spark, folder, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op5_tokencount(spark, folder):
    p = tokencount.CountParams(public_tokenizers.path("word_bpe_49k.json"))
    return tokencount.count_tokens(table(spark, folder, "documents"), scratch_path(spark, "token-cache"), p)


@query
def op6_langid(spark, folder):
    return langid.identify(table(spark, folder, "documents"))


@query
def op7_lattice(spark, folder):
    return lattice.near_vectors(table(spark, folder, "embeddings"))


@query
def op8_warc(spark, folder):
    archive = scratch_path(spark, "warc")
    warc.write(table(spark, folder, "pages"), archive)
    return warc.fields(warc.read(spark, archive))


@query
def op9_topk(spark, folder):
    return search.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op10_toxicity(spark, folder):
    return toxicity.detect(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op11_tokenfiles(spark, folder):
    target = scratch_path(spark, "token-files")
    tokenfiles.write(table(spark, folder, "documents"), target, tokenfiles.FileParams(public_tokenizers.path("word_bpe_49k.json")))
    return tokenfiles.read(spark, target).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op12_runs(spark, folder):
    return runs.find(table(spark, folder, "documents"), plant=True)


@query
def op13_merkle(spark, folder):
    tampered = F.when(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.verified(merkle.manifest(table(spark, folder, "documents"), checked=tampered))


@query
def pipeline(spark, folder):
    return corpus_pipeline.run(spark, folder)


if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
