"""Taxonomy search and classification over tables.

Queries are distinct texts.  Lexical evidence is found through token joins, at
token level first so that one frequent word is ranked once and not per query;
vector evidence through blocked exhaustive scoring.  Cosines are rounded to six
and blended scores to eight decimals before ranking, ties go to the smaller commodity code.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry import fixed_values as fv
from attestry.functions import similarity as sim
from attestry.functions import text as tx
from attestry.functions import vectors as vec
from attestry.operators import scanning
from attestry.operators.matching import block_topk
from attestry.operators.namesearch import nearest_paths
from attestry.params import DEFAULTS, Params
from attestry.session import cut_lineage


def path_text() -> Column:
    return F.concat_ws(">", "segment_name", "family_name", "class_name", "commodity_name")


def class_groups(taxonomy: DataFrame) -> DataFrame:
    return taxonomy.groupBy("class_code").agg(
        F.min("class_name").alias("class_name"), F.min("family_name").alias("family_name"),
        F.min("segment_name").alias("segment_name"),
        F.array_sort(F.collect_list(F.struct("commodity_code", "commodity_name"))).alias("commodities"))


# ---- lexical evidence ------------------------------------------------------------------

def _tokens(df: DataFrame, keys: list[str], text: str, n: int) -> DataFrame:
    return df.select(*keys, F.explode(tx.words(F.col(text), n)).alias("token"))


def token_hits(queries: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(token, commodity_code, class_code, lex): best ratio of each distinct query
    token with a commodity token that shares its first four characters."""
    prefix = F.left("token", F.lit(4)).alias("prefix")
    q = _tokens(queries, [], "query", 4).distinct().select("token", prefix)
    c = _tokens(taxonomy, ["commodity_code", "class_code"], "commodity_name", 4).distinct()
    ct = c.select(F.col("token").alias("other"), F.left("token", F.lit(4)).alias("prefix")).distinct()
    scored = q.join(ct, "prefix").select("token", "other", sim.indel(F.col("token"), F.col("other")).alias("ratio"))
    return (scored.join(c.withColumnRenamed("token", "other"), "other")
            .groupBy("token", "commodity_code", "class_code").agg(F.max("ratio").alias("lex")))


def _top(df: DataFrame, by: list[str], score: str, k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(score), "commodity_code")
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")


def prefix_best(queries: DataFrame, hits: DataFrame, k: int, by: list[str] = [], within: DataFrame | None = None) -> DataFrame:
    """k best commodities per query (and per extra key) by prefix-guarded ratio,
    in the (query_id, class_code) pairs of `within` if given: those are looked up
    before anything is ranked.  The k best of a maximum over tokens lie within the
    k best of each token."""
    per_token = _top(hits, ["token", *by], "lex", k)
    qt = _tokens(queries, ["query_id"], "query", 4).distinct()
    found = qt.join(per_token, "token") if within is None else qt.join(within.select("query_id", "class_code"), "query_id").join(per_token, ["token", "class_code"])
    best = (found.groupBy("query_id", "commodity_code", "class_code")
            .agg(F.max("lex").alias("lex")))
    return _top(best, ["query_id", *by], "lex", k)


def coverage_best(queries: DataFrame, taxonomy: DataFrame, k: int) -> DataFrame:
    """k best commodities per query by the share of their tokens (three or more
    characters, repeats counted) found in the query.  Equality on the first four
    characters covers both exact and prefix matches: a three-character token can
    only equal itself.  Queries with the same token set are scored once."""
    mark = F.left("token", F.lit(4))
    sets = queries.select("query_id", F.array_sort(F.array_distinct(F.transform(
        tx.words(F.col("query"), 3), lambda w: F.left(w, F.lit(4))))).alias("marks"))
    c = _tokens(taxonomy, ["commodity_code", "class_code"], "commodity_name", 3).withColumn("mark", mark)
    counts = c.groupBy("commodity_code", "class_code", "mark").agg(F.count("*").alias("n"))
    totals = c.groupBy("commodity_code").agg(F.count("*").alias("total"))
    distinct = sets.select("marks").distinct()
    found = (distinct.select("marks", F.explode("marks").alias("mark")).join(counts, "mark")
             .groupBy("marks", "commodity_code", "class_code").agg(F.sum("n").alias("n")))
    scored = found.join(totals, "commodity_code").select(
        "marks", "commodity_code", "class_code", (F.lit(100.0) * F.col("n") / F.col("total")).alias("cover"))
    return sets.join(_top(scored, ["marks"], "cover", k), "marks").select("query_id", "commodity_code", "class_code", "cover")


# ---- vector evidence ---------------------------------------------------------------------

def mean_vectors(vectors: DataFrame, by: str, column: str = "embedding") -> DataFrame:
    """Unit-length mean vector per group, element by element so that a large group
    is summed in parts."""
    parts = vectors.select(by, F.posexplode(column).alias("pos", "x"))
    means = parts.groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    packed = means.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("p"))
    return packed.select(by, vec.l2_normalize(F.transform("p", lambda e: e["x"])).alias("vector"))


def _cosine(k: int):
    def score(q: pd.DataFrame, e: pd.DataFrame):
        e = e.sort_values("class_code", ignore_index=True)
        codes = e["class_code"].to_numpy()
        matrix = np.stack(e["vector"].to_numpy())
        for at in range(0, len(q), 1024):
            part = q.iloc[at:at + 1024]
            sims = np.round(np.stack(part["vector"].to_numpy()) @ matrix.T, 6)
            # stable order keeps code order among equal scores
            top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
            n = top.shape[1]
            yield pd.DataFrame({"query_id": np.repeat(part["query_id"].to_numpy(), n),
                                "class_code": codes[top].ravel(),
                                "cos": np.take_along_axis(sims, top, 1).ravel()})

    return score


def nearest_classes(queries: DataFrame, classes: DataFrame, k: int = DEFAULTS.class_pool) -> DataFrame:
    """k best classes per query vector; (query_id, class_code, cos, rank)."""
    q = queries.where(F.col("vector").isNotNull()).select("query_id", "vector")
    return block_topk(q, classes.select("class_code", "vector"), k, _cosine(k), "query_id",
                      "query_id bigint, class_code string, cos double", [F.desc("cos"), F.col("class_code")])


def class_scores(pairs: DataFrame, queries: DataFrame, classes: DataFrame) -> DataFrame:
    """Add `cos` for given (query_id, class_code) pairs; a missing vector scores zero."""
    wanted = pairs.select("query_id", "class_code").distinct()
    scored = (wanted.join(queries.select("query_id", F.col("vector").alias("qv")), "query_id")
              .join(classes.select("class_code", F.col("vector").alias("cv")), "class_code")
              .select("query_id", "class_code", F.round(vec.dot(F.col("qv"), F.col("cv")), 6).alias("cos")))
    return pairs.join(scored, ["query_id", "class_code"], "left").withColumn("cos", F.coalesce("cos", F.lit(0.0)))


# ---- search ------------------------------------------------------------------------------

def candidate_pool(queries: DataFrame, taxonomy: DataFrame, classes: DataFrame, p: Params = DEFAULTS, whole: bool = True) -> DataFrame:
    """Best blended score per (query, commodity) over three branches: nearest
    classes, prefix matches, and phrase coverage.  Not `whole`: without wordless
    commodities of classes from which none can be among the best k."""
    k, lexical = p.classify_limit, max(50, 5 * p.classify_limit)
    hits = token_hits(queries, taxonomy)
    near = nearest_classes(queries, classes, p.class_pool).select("query_id", "class_code", "cos", "rank")
    inside = prefix_best(queries, hits, k, ["class_code"], near)
    worded = near.join(inside, ["query_id", "class_code"]).select(
        "query_id", "commodity_code", (0.8 * F.col("cos") + 0.2 * F.col("lex") / 100).alias("score"))
    # commodities without any word in common fill a class up to k, in code order; only
    # the best k classes (with ties) can place such a commodity among the best k
    first = _top(taxonomy.select("class_code", "commodity_code", F.lit(0).alias("z")), ["class_code"], "z", 2 * k)
    by_cos = Window.partitionBy("query_id").orderBy(F.desc("cos"))
    best = near if whole else near.withColumn("__r", F.rank().over(by_cos)).where(F.col("__r") <= k).drop("__r")
    used = inside.select("query_id", "class_code", "commodity_code", F.lit(True).alias("hit"))
    filled = best.join(first, "class_code").join(used, ["query_id", "class_code", "commodity_code"], "left")
    order = Window.partitionBy("query_id", "class_code").orderBy(F.col("hit").isNull(), "commodity_code")
    blank = (filled.withColumn("__r", F.row_number().over(order)).where((F.col("__r") <= k) & F.col("hit").isNull())
             .select("query_id", "commodity_code", (0.8 * F.col("cos")).alias("score")))
    prefix = class_scores(prefix_best(queries, hits, lexical), queries, classes).select(
        "query_id", "commodity_code", (0.7 * F.col("cos") + 0.3 * F.col("lex") / 100).alias("score"))
    cover = F.col("cover") / 100
    phrase = class_scores(coverage_best(queries, taxonomy, lexical), queries, classes).select(
        "query_id", "commodity_code", F.greatest(0.7 * F.col("cos") + 0.3 * cover, 0.85 * cover).alias("score"))
    pool = worded.unionByName(blank).unionByName(prefix).unionByName(phrase)
    return pool.groupBy("query_id", "commodity_code").agg(F.round(F.max("score"), 8).alias("score"))


def search(queries: DataFrame, taxonomy: DataFrame, classes: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """The k best commodities per query with rank, name and path."""
    pool = candidate_pool(queries, taxonomy, classes, p, whole=False)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "commodity_code")
    top = pool.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= p.classify_limit)
    names = taxonomy.select("commodity_code", "commodity_name", path_text().alias("classpath"))
    return top.join(names, "commodity_code")


# ---- decision ----------------------------------------------------------------------------

def margins(ranked: DataFrame) -> DataFrame:
    """Score of rank 1 and its distance to rank 2, per query."""
    lead = ranked.where(F.col("rank") <= 2).groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    return lead.withColumn("margin", F.round(F.col("top") - F.col("second"), 6))


def sibling_override(ranked: DataFrame, queries: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Pick the preferred sibling where the text triggers the rule, carries no
    veto, and a rival sibling is among the candidates; its score is lifted just
    above the sanity bar."""
    rule = lambda pattern: "(?iuU)" + pattern
    text = F.col("query")
    asked = queries.where(text.rlike(rule(fv.SIBLING_TRIGGER)) & ~text.rlike(rule(fv.SIBLING_VETO))).select("query_id")
    name = tx.casefold(F.col("commodity_name"))
    kind = F.col("commodity_name").rlike(rule(fv.SIBLING_NAME))
    rival = name.contains(fv.SIBLING_RIVAL) & kind
    wanted = tx.casefold(F.col("classpath")).contains(fv.SIBLING_PREFERRED) & kind & ~name.contains(fv.SIBLING_EXCLUDED)
    pick = F.struct("commodity_code", "classpath", "score")
    agg = ranked.join(asked, "query_id", "left_semi").groupBy("query_id").agg(
        F.max(rival).alias("rival"), F.min_by(F.when(wanted, pick), F.when(wanted, F.col("rank"))).alias("p"))
    return agg.where(F.col("rival") & F.col("p").isNotNull()).select(
        "query_id", "p.commodity_code", "p.classpath",
        F.round(F.greatest("p.score", F.lit(p.classify_sanity + 0.01)), 6).alias("score"))


def decide(ranked: DataFrame, queries: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """One row per query: chosen commodity or NULL, outcome, and flag codes.  A close
    or low leader goes to review; below the acceptance bar nothing is chosen."""
    top = ranked.where(F.col("rank") <= 2).groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.struct("commodity_code", "classpath", "score"))).alias("one"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    over = sibling_override(ranked, queries, p).select("query_id", F.struct("commodity_code", "classpath", "score").alias("over"))
    d = queries.select("query_id").join(top, "query_id", "left").join(over, "query_id", "left")
    contested = F.col("over").isNull() & F.col("second").isNotNull()
    close = F.coalesce(contested & (F.round(F.col("one.score") - F.col("second"), 6) <= p.classify_margin), F.lit(False))
    low = F.coalesce(contested & (F.col("one.score") < p.classify_sanity), F.lit(False))
    d = d.withColumn("close", close).withColumn("low", low)
    cand = F.when(F.col("over").isNotNull(), F.col("over")).when(~F.col("close") & ~F.col("low"), F.col("one"))
    chosen = F.when(cand["score"] >= p.classify_accept, cand)
    d = d.withColumn("chosen", chosen)
    outcome = F.when(F.col("over").isNotNull(), "deterministic_context_rule").when(
        F.col("close") | F.col("low"), "deterministic_review")
    flags = F.array_compact(F.array(
        F.when(F.col("close"), "classification_close_margin").when(F.col("low"), "classification_low_score"),
        F.when(F.col("chosen").isNull(), "classification_unresolved")))
    return d.select("query_id", F.col("chosen.commodity_code").alias("code"), F.col("chosen.classpath").alias("classpath"),
                    F.least(F.greatest(F.coalesce("chosen.score", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("confidence"),
                    outcome.alias("outcome"), flags.alias("flags"))


def classify(queries: DataFrame, taxonomy: DataFrame, classes: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """`decide` over `search` for (query_id, query, vector) of which many are alike.  An answer follows from text and vector alone, so of
    the queries without a vector one speaks for all of its text; a query with a vector speaks for itself."""
    bare = F.col("vector").isNull()
    voices = cut_lineage(queries.where(bare).groupBy("query").agg(F.min("query_id").alias("voice")))
    asked = cut_lineage(voices.select(F.col("voice").alias("query_id"), "query", F.lit(None).cast(queries.schema["vector"].dataType).alias("vector"))
                        .unionByName(queries.where(~bare).select("query_id", "query", "vector")))
    answers = cut_lineage(decide(search(asked, taxonomy, classes, p), asked, p)).withColumnRenamed("query_id", "voice")
    same = voices.withColumnRenamed("query", "__text")
    heard = queries.where(bare).join(same, F.col("query").eqNullSafe(F.col("__text"))).select("query_id", "voice").unionByName(
        queries.where(~bare).select("query_id", F.col("query_id").alias("voice")))
    return heard.join(answers, "voice").drop("voice")


# ---- paths ---------------------------------------------------------------------------------

def nearest_path(paths: DataFrame, catalog_paths: DataFrame, cutoff: float = DEFAULTS.category_cutoff, chunk: int = scanning.CHUNK,
                 sent: int = scanning.SENT) -> DataFrame:
    """(classpath, path, score): best catalog path per distinct path at or above the
    cutoff.  A path that is itself in the catalog scores 100 and needs no search."""
    want = cut_lineage(paths.select("classpath").where(F.col("classpath").isNotNull()).distinct())
    have = cut_lineage(catalog_paths.select("path").distinct())
    exact = want.join(have, F.col("classpath") == F.col("path")).select("classpath", "path", F.lit(100.0).alias("score"))
    rest = want.join(have.withColumnRenamed("path", "classpath"), "classpath", "left_anti")
    asked = rest.withColumnRenamed("classpath", "asked")
    near = scanning.scan(asked, ["asked"], "asked", have, "path", nearest_paths(1), chunk, sent).where(F.col("score") >= cutoff)
    best = near.groupBy(F.col("asked").alias("classpath")).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("key").alias("path"))).alias("b"))
    return exact.unionByName(best.select("classpath", "b.path", (-F.col("b.s")).alias("score")))
