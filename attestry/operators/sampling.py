"""Greedy selection of a small, varied sample by term novelty."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions import text as tx
from attestry.session import cut_lineage


def diverse_sample(items: DataFrame, k: int, text: str = "text", maker: str = "maker", item: str = "item_id",
                   min_chars: int = 22, pool: int = 1000) -> DataFrame:
    """Pick k items by novelty + 0.25 * length share + 0.2 for an unused maker.

    Scores only fall as picks are made, so a score from before is an upper bound.
    A round brings all items up to date with the picks made since the round before,
    takes the `pool` best ones with their terms, and picks from them for as long
    as the best one beats the best item left outside, whose score is stale.
    Ties go to the smaller id.  Texts under `min_chars` are not eligible, and a NULL
    maker counts as one maker, the empty name.
    """
    spark = items.sparkSession
    rows = items.where(F.length(F.trim(text)) >= min_chars).select(
        item, F.coalesce(F.col(maker), F.lit("")).alias("maker"), F.col(text).alias("__t"))
    terms = rows.select(item, F.explode(tx.content_words(F.col("__t"))).alias("term"))
    total = rows.count()
    df = terms.groupBy("term").agg(F.count("*").alias("__df"))
    w = terms.join(df, "term").select(item, "term", (F.log(F.lit(float(total + 1)) / (F.col("__df") + 1)) + 1).alias("w"))
    weights = cut_lineage(w)
    norms = weights.groupBy(item).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    state = cut_lineage(rows.join(norms, item, "left").select(
        item, "maker", "norm", (F.least(F.length("__t") / 100.0, F.lit(1.0)) * 0.25).alias("rich"), F.lit(0.0).alias("sim")))
    picked, used, new = [], set(), []
    while len(picked) < min(k, total):
        if new:
            mine = spark.createDataFrame([(n, t, x) for n, own in enumerate(new) for t, x in own], "__pick int, term string, __x double")
            dots = weights.join(mine, "term").groupBy(item, "__pick").agg(F.sum(F.col("w") * F.col("__x")).alias("dot"))
            dots = dots.groupBy(item).agg(F.max("dot").alias("dot"))
            state = cut_lineage(state.join(dots, item, "left").select(
                item, "maker", "norm", "rich", F.greatest("sim", F.coalesce(F.col("dot") / F.col("norm"), F.lit(0.0))).alias("sim")))
        left = state.where(~F.col(item).isin([p[0] for p in picked])) if picked else state
        fresh = ~F.col("maker").isin(list(used)) if used else F.lit(True)
        score = F.round(1.0 - F.col("sim") + F.col("rich") + F.when(fresh, 0.2).otherwise(0.0), 9)
        best = left.select(item, "maker", "norm", "rich", "sim", score.alias("score")).orderBy(F.desc("score"), item).limit(pool + 1).collect()
        if not best:
            break
        outside = (-best[pool]["score"], best[pool][0]) if len(best) > pool else None
        own = weights.join(spark.createDataFrame([(r[0],) for r in best[:pool]], state.select(item).schema), item).collect()
        new = _picks(best[:pool], own, k - len(picked), outside, used, picked)
    return spark.createDataFrame(picked, f"{item} bigint, pick int, score double")


def _picks(pool: list, own: list, k: int, outside: tuple | None, used: set, picked: list) -> list:
    """Pick from the pool until k are found or an item outside may be better; the picks' unit vectors."""
    ids, terms = {r[0]: i for i, r in enumerate(pool)}, {}
    owner = np.array([ids[r[0]] for r in own], np.int64)
    term = np.array([terms.setdefault(r["term"], len(terms)) for r in own], np.int64)
    weight = np.array([r["w"] for r in own])
    names = list(terms)
    norm = np.array([r["norm"] or 0.0 for r in pool])
    rich, sim = np.array([r["rich"] for r in pool]), np.array([r["sim"] for r in pool])
    free, new = np.ones(len(pool), bool), []
    while k > len(new) and free.any():
        scores = [round(1.0 - sim[i] + rich[i] + (0.0 if r["maker"] in used else 0.2), 9) if free[i] else None for i, r in enumerate(pool)]
        score, name, i = min((-s, pool[i][0], i) for i, s in enumerate(scores) if s is not None)
        if new and outside and (score, name) >= outside:        # the first pick is up to date with every item
            break
        free[i] = False
        picked.append((name, len(picked) + 1, float(-score)))
        used.add(pool[i]["maker"])
        mine = np.nonzero(owner == i)[0]
        unit = np.zeros(len(names))
        if norm[i]:
            unit[term[mine]] = weight[mine] / norm[i]
        new.append([(names[t], float(unit[t])) for t in term[mine].tolist()])
        dots = np.bincount(owner, weight * unit[term], minlength=len(pool)) if len(own) else np.zeros(len(pool))
        sim = np.maximum(sim, np.divide(dots, norm, out=np.zeros(len(pool)), where=norm > 0))
    return new
