"""Mix sources to target shares of all words: certain whole copies, then Pareto order sampling of fixed size.

A source's target is its weighted share of all words, stopped at `max_copies`
times what it has; what is above goes to the others by weight.  Every
document is first taken a certain whole number of times; the rest is a sample
of fixed size (in words) in Pareto order: documents are ranked by random odds
over inclusion odds, u / (1 - u) over pi / (1 - pi), and taken from the
smallest on while they fit into the source's words; what the last that does
not fit leaves open goes to others that do (`rounds` times).
Documents may carry weights of their own; then inclusion is unequal inside a
source too.

No rank over all rows is made: a histogram of the order (`BUCKETS` per source)
finds the bucket where each source's words run out, and only that bucket is
ordered, in each round.  The result is a plan with one row per source and weight class,
which any task can apply to a document alone.

Cases: null and empty texts have size 0 and are never taken; null sources form
one source, the last; rows that repeat an id stand or fall together; extra
columns are ignored; an empty table gives an empty table.  The table of
sources and weight classes is ordered in one task; it has one row per
(source, weight rounded to 1/100), not per document.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.common import stored

#: steps of the order's histogram in each source: rows of the one step that has to be ordered are 1 / BUCKETS of the source's
BUCKETS = 4096
#: bits of the random number of a document
BITS = 52
_PLACE = "struct<step:bigint,odds:double,doc_id:bigint,size:bigint>"


@dataclass(frozen=True)
class MixParams:
    max_copies: float = 3.0
    cycle: int = 3              # sources weigh 1 .. cycle, repeating, by code point
    rounds: int = 3             # runs down the order; later ones fill what is left with documents that fit
    seed: str = "mix-1"


def words(text: Column) -> Column:
    """Number of runs without ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(doc_id: Column, p: MixParams) -> Column:
    """A number in (0, 1) that depends on the id and the seed only."""
    text = F.concat_ws(":", F.lit(p.seed), F.coalesce(doc_id.cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long") + 0.5) / float(2 ** BITS)


def _filled(parts: DataFrame, by: list[str], total: str, p: MixParams) -> DataFrame:
    """Split `total` over rows by weight, none above max_copies * size, what is above shared again: the level is the
    first one that a row, in order of cap per weight, can hold."""
    cap = F.col("size_all") * p.max_copies
    order = Window.partitionBy(*by).orderBy((cap / F.col("weight")).asc(), *[F.col(c).asc_nulls_last() for c in ("source", "weight")])
    whole = Window.partitionBy(*by)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = parts.withColumn("level", (F.col(total) - used) / left).withColumn("at", F.row_number().over(order))
    rows = rows.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= cap, F.struct("at", "level"))).over(whole)["level"])
    filled = F.when(F.col("level").isNull(), cap).otherwise(F.least(cap, F.col("level") * F.col("weight")))
    return rows.withColumn("target", filled).drop("level", "at")


def _class_weight(weight: Column | None) -> Column:
    if weight is None:
        return F.lit(1.0)
    return F.greatest(F.lit(0.01), F.round(F.coalesce(weight.cast("double"), F.lit(1.0)), 2))


def sized(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """(doc_id, source, size, weight) of each document: all that planning needs."""
    own = _class_weight(weight)
    return docs.select("doc_id", "source", words(F.col("text")).alias("size"), own.alias("weight"))


def _ordered(docs: DataFrame, plan: DataFrame, p: MixParams) -> DataFrame:
    """Join each sized document to its class and give it its place in the order: step, odds ratio, id, size."""
    d = docs.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.weight") == F.col("p.weight")))
    u = uniform(F.col("doc_id"), p)
    odds = lambda x: x / (1.0 - x)
    d = d.select("d.*", *[F.col(f"p.{c}") for c in plan.columns if c not in ("source", "weight")])
    d = d.withColumn("odds", F.when((F.col("pi") > 0) & (F.col("size") > 0), odds(u) / odds(F.col("pi"))))
    scaled = F.col("odds") * odds(F.col("pi_source"))  # spread evenly over (0, 1) where inclusion is equal
    return d.withColumn("step", F.floor(scaled / (1.0 + scaled) * BUCKETS).cast("long"))


def make_plan(sizes: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """(source, weight, source_size, source_target, copies, pi, pi_source, words_left, cuts, limits), one row per source and
    weight class; `sizes` should be a stored table, it is read several times."""
    classes = sizes.groupBy("source", "weight").agg(F.sum("size").alias("size_all"))
    sources = classes.groupBy("source").agg(F.sum("size_all").alias("size_all"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    sources = sources.withColumn("weight", ((place - 1) % p.cycle + 1).cast("double")).withColumn("total", F.sum("size_all").over(Window.partitionBy()))
    sources = _filled(sources, [], "total", p).select("source", F.col("size_all").alias("source_size"), F.col("target").alias("source_target"))
    own = classes.alias("c").join(sources.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))).select("c.*", "s.source_size", "s.source_target")
    # a document of weight w is to be taken level * w times, so a class shares its source's words by weight * size
    own = own.withColumn("own_weight", F.col("weight")).withColumn("weight", F.col("weight") * F.greatest(F.col("size_all"), F.lit(1)))
    own = _filled(own, ["source"], "source_target", p).withColumn("weight", F.col("own_weight"))
    times = F.when(F.col("size_all") > 0, F.col("target") / F.col("size_all")).otherwise(0.0)
    own = own.withColumn("copies", F.floor(times)).withColumn("pi", times - F.col("copies"))
    inside = Window.partitionBy("source")
    own = own.withColumn("words_left", F.col("source_target") - F.sum(F.col("copies") * F.col("size_all")).over(inside))
    own = own.withColumn("pi_source", F.sum(F.col("pi") * F.col("size_all")).over(inside) / F.greatest(F.lit(1), F.max("source_size").over(inside)))
    own = stored(own.select("source", "weight", "source_size", "source_target", "copies", "pi", "pi_source", "words_left"), "mix-classes")

    plan = own.withColumns({"cuts": F.array().cast(f"array<{_PLACE}>"), "limits": F.array().cast("array<long>")})
    for done in range(p.rounds):
        plan = stored(_next_cut(sizes, plan, done, p), "mix-plan")
    return plan


def _place() -> Column:
    return F.struct(F.col("step"), F.col("odds"), F.col("doc_id"), F.col("size")).cast(_PLACE)


def _sampled(rounds: int) -> Column:
    """True if one of the first rounds took the document: it was not taken before, fits, and comes no later than the round's cut."""
    taken = F.lit(False)
    for j in range(1, rounds + 1):
        taken = taken | ((F.col("size") <= F.try_element_at("limits", F.lit(j))) & (_place() <= F.try_element_at("cuts", F.lit(j))))
    return taken


def _next_cut(sizes: DataFrame, plan: DataFrame, done: int, p: MixParams) -> DataFrame:
    """Run once more down the order, over documents that were not taken and fit into the words still left."""
    last = done + 1 == p.rounds
    limit = F.lit(2 ** 62) if not done else F.floor(F.greatest(F.lit(0.0), F.col("words_left")) * (2 if last else 1)).cast("long")
    placed = _ordered(sizes, plan, p).where("odds is not null").where(~_sampled(done) & (F.col("size") <= limit)).withColumn("place", _place())
    steps = placed.groupBy("source", "step").agg(F.sum("size").alias("words"), F.max("words_left").alias("words_left"), F.max("place").alias("top"))
    upto = Window.partitionBy("source").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("words_before", F.coalesce(F.sum("words").over(upto), F.lit(0))).withColumn("top_before", F.max("top").over(upto))
    edge = steps.where("words_before <= words_left and words_left < words_before + words").select(
        F.col("source").alias("edge_source"), F.col("step").alias("edge_step"), "words_before", "top_before")
    inside = placed.join(edge, F.col("source").eqNullSafe(F.col("edge_source")) & (F.col("step") == F.col("edge_step")))
    run = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    after = F.col("words_before") + F.coalesce(F.sum("size").over(run), F.lit(0)) + F.col("size") / (2 if last else 1)
    inside = inside.select("source", "step", "place", "size", "words_before", "top_before", (after <= F.col("words_left")).alias("taken"))
    cuts = inside.groupBy("source").agg(
        F.coalesce(F.max(F.when(F.col("taken"), F.col("place"))), F.max("top_before")).alias("cut"),
        (F.max("words_before") + F.coalesce(F.sum(F.when(F.col("taken"), F.col("size"))), F.lit(0))).alias("used"))
    # a source whose words all fit has no edge: it is taken to the end
    whole = steps.groupBy("source").agg(F.sum("words").alias("words"), F.max("top").alias("top"))
    cuts = whole.alias("w").join(cuts.alias("c"), F.col("w.source").eqNullSafe(F.col("c.source")), "left").select(
        F.col("w.source").alias("cut_source"), F.when(F.col("c.used").isNull(), F.col("w.top")).otherwise(F.col("c.cut")).alias("cut"),
        F.coalesce("c.used", "w.words").alias("used"))
    found = plan.join(cuts, F.col("source").eqNullSafe(F.col("cut_source")), "left")
    start = F.struct(F.lit(-1), F.lit(-1.0), F.lit(None), F.lit(None)).cast(_PLACE)
    return found.select(*[c for c in plan.columns if c not in ("words_left", "cuts", "limits")],
                        (F.col("words_left") - F.coalesce("used", F.lit(0))).alias("words_left"),
                        F.concat("cuts", F.array(F.coalesce("cut", start))).alias("cuts"), F.concat("limits", F.array(limit)).alias("limits"))


def apply_plan(docs: DataFrame, plan: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """Add `times` (how often the mix takes the document), `source_size` and `source_target` to sized documents; other columns stay."""
    d = _ordered(docs, plan, p)
    sampled = F.when(F.col("odds").isNotNull() & _sampled(p.rounds), 1).otherwise(0)
    d = d.withColumn("times", F.when(F.col("size") > 0, F.col("copies") + sampled).otherwise(0).cast("long"))
    return d.select(*docs.columns, "times", "source_size", "source_target")


def mix(docs: DataFrame, weight: Column | None = None, p: MixParams = MixParams()) -> DataFrame:
    """(doc_id, source, size, weight, times, source_size, source_target) for every document."""
    sizes = stored(sized(docs, weight), "mix-sizes")
    return apply_plan(sizes, make_plan(sizes, p), p)


def repeated(docs: DataFrame, weight: Column | None = None, p: MixParams = MixParams()) -> DataFrame:
    """The mixed corpus itself: each document as often as it is taken, its columns as they were."""
    plan = make_plan(stored(sized(docs, weight), "mix-sizes"), p)
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", words(F.col("text")).alias("size"), _class_weight(weight).alias("weight"))
    taken = apply_plan(rows, plan, p).where("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")).select("row.*")
