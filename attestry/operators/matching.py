"""Joins that replace loops over pairs: substring containment, term-overlap cosine for given pairs, and exhaustive top-k scoring in
bounded blocks."""

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.operators import scanning
from attestry.params import DEFAULTS
from attestry.session import stored


def grams(text: Column, q: int) -> Column:
    """Distinct character q-grams; empty for shorter text."""
    count = F.length(text) - (q - 1)
    return F.when(count >= 1, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substr(text, i, F.lit(q))))
    ).otherwise(F.array().cast("array<string>"))


def contains_join(texts: DataFrame, text: str, keys: DataFrame, key: str, chunk: int = scanning.CHUNK, sent: int = scanning.SENT) -> DataFrame:
    """Distinct (text, key) pairs where the key occurs anywhere inside the text.  Callers that have a row id rather scan with it."""
    found = scanning.scan(texts.select(text), [text], text, keys, key, scanning.contained, chunk, sent)
    return found.select(text, F.col("key").alias(key)).distinct()


def pair_cosine(terms: DataFrame, pairs: DataFrame, doc: str = "doc_id", term: str = "term") -> DataFrame:
    """Cosine with binary term counts and smoothed idf for the given (left_id,
    right_id) pairs.  Only terms the two sides share are ever joined.  Terms are
    found and weighed once and written; the joins below read numbers for them."""
    terms = stored(terms.select(doc, term).distinct(), "cosine-terms")
    n_docs = terms.select(doc).distinct().count()
    df = terms.where(F.col(term).isNotNull()).groupBy(term).agg(F.count("*").alias("__df"))
    df = stored(df.withColumn("__term", F.monotonically_increasing_id()), "cosine-vocabulary")
    weighted = stored(terms.join(df, term).select(
        doc, "__term", (F.log((F.lit(float(n_docs + 1))) / (F.col("__df") + 1)) + 1).alias("w")), "cosine-weights")
    norms = weighted.groupBy(doc).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    left = weighted.withColumnRenamed(doc, "left_id")
    right = weighted.select(F.col(doc).alias("right_id"), "__term")
    dots = (pairs.join(left, "left_id").join(right, ["right_id", "__term"])
            .groupBy("left_id", "right_id").agg(F.sum(F.col("w") * F.col("w")).alias("dot")))
    ln = norms.select(F.col(doc).alias("left_id"), F.col("norm").alias("ln"))
    rn = norms.select(F.col(doc).alias("right_id"), F.col("norm").alias("rn"))
    return (pairs.join(dots, ["left_id", "right_id"], "left").join(ln, "left_id", "left")
            .join(rn, "right_id", "left")
            .select("left_id", "right_id",
                    F.coalesce(F.col("dot") / (F.col("ln") * F.col("rn")), F.lit(0.0)).alias("cosine")))


def block_topk(queries: DataFrame, entries: DataFrame, k: int,
               score: Callable[[pd.DataFrame, pd.DataFrame], Iterator[pd.DataFrame]],
               query_id: str, out_schema: str, order: list[Column],
               rows: int = DEFAULTS.score_rows, block: int = DEFAULTS.score_block) -> DataFrame:
    """Score every query against every entry and keep the k best per query.

    For scorers without a usable join key.  Queries are spread over salts of about
    `rows`, entries over blocks of about `block`; each (salt, block) pair is one
    bounded task-side group that returns at most k rows per query, so neither
    side is ever whole in one place and no pair table exists.
    """
    n_salts = max(1, math.ceil(queries.count() / rows))
    n_blocks = max(1, math.ceil(entries.count() / block))
    if n_salts * n_blocks < 8:  # small inputs: still use a handful of tasks
        n_salts = max(n_salts, 8)
    qs = queries.withColumn("__salt", F.pmod(F.xxhash64(query_id), F.lit(n_salts)).cast("int"))
    qs = qs.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    es = entries.withColumn("__block", F.pmod(F.xxhash64(*entries.columns[:1]), F.lit(n_blocks)).cast("int"))
    es = es.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(n_salts - 1))))

    def run(q: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        parts = list(score(q, e)) if len(q) and len(e) else []
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=names)

    names = [f.strip().split(" ")[0] for f in out_schema.split(",")]
    part = (qs.groupBy("__salt", "__block").cogroup(es.groupBy("__salt", "__block"))
            .applyInPandas(run, out_schema))
    from pyspark.sql import Window

    w = Window.partitionBy(query_id).orderBy(*order)
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
