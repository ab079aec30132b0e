"""Merkle manifest of a dataset: a tree over each source's documents, a tree over the sources' roots, and a proof for each document.

A slot pivot climbs a level: children are grouped by parent, conditional
aggregates spread their digests into `fanout` columns, and the digest of the
columns side by side is the parent's.  On the way down each child keeps what
stands before and after its own slot; these are its siblings, and a proof is
the list of them from the document to the root.

Documents are numbered inside their source by a range partitioning over
(source, id, leaf): numbers inside a partition plus a prefix sum of the
partitions' counts, so that no source is ever in one task.  Levels are written
to the shared folder, one small table each.

Cases: null fields are written `-`, which no value is; a null id sorts first,
and its check sum is that of the empty text; rows that repeat an id are leaves
of their own, ordered by leaf; a source with one document has its leaf as root;
extra columns are ignored; an empty table gives an empty table.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import stored

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


@dataclass(frozen=True)
class MerkleParams:
    fanout: int = 3
    rows: int = 100_000         # documents that a range partition is meant to hold


def written(c: Column) -> Column:
    """A field as bytes that can't run into the next: `-`, or its UTF-8 length, a colon and the value."""
    text = c.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*[written(f) for f in fields]), 256)


def numbered(df: DataFrame, group: str, order: list[str], p: MerkleParams) -> DataFrame:
    """`df` with `k`, the row's number (from 0) inside `group` by `order`, and `size`, the group's rows; groups are not null."""
    parts = max(1, -(-df.count() // p.rows))
    keys = [F.col(c).asc_nulls_first() for c in [group, *order]]
    ranged = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ranged = stored(ranged.withColumn("at", F.monotonically_increasing_id()), "merkle-ranged").withColumn("part", F.shiftright("at", 33))
    counts = ranged.groupBy("part", group).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = "sum(n) over (partition by `{}` order by part rows between unbounded preceding and 1 preceding)".format(group)
    counts = counts.select("part", group, "first", F.expr(f"coalesce({before}, 0)").alias("base"), F.expr(f"sum(n) over (partition by `{group}`)").alias("size"))
    return ranged.join(counts, ["part", group]).withColumn("k", F.col("base") + F.col("at") - F.col("first")).drop("part", "at", "first", "base")


def climb(nodes: DataFrame, p: MerkleParams) -> list[DataFrame]:
    """Levels above `nodes` (tree, size, k, digest): (tree, size, k, s0 .. , digest), the children's digests in their slots;
    trees of one node have none."""
    most, levels = nodes.agg(F.max("size")).first()[0] or 0, []
    slots = [f"s{i}" for i in range(p.fanout)]
    while most > 1:
        spread = [F.max(F.when(F.col("k") % p.fanout == i, F.col("digest"))).alias(s) for i, s in enumerate(slots)]
        parents = nodes.where("size > 1").groupBy("tree", F.ceil(F.col("size") / p.fanout).alias("size"), F.expr(f"k div {p.fanout}").alias("k")).agg(*spread)
        nodes = stored(parents.withColumn("digest", F.sha2(F.concat_ws("", *slots), 256)), "merkle-level")
        levels.append(nodes)
        most = -(-most // p.fanout)
    return levels


def siblings(slot: str, p: MerkleParams) -> str:
    """SQL for what stands before and after a slot in its parent's columns."""
    side = lambda sign: ", ".join(f"if({i} {sign} {slot}, s{i}, null)" for i in range(p.fanout))
    return f"named_struct('before', concat_ws('', {side('<')}), 'after', concat_ws('', {side('>')}))"


def descend(levels: list[DataFrame], tops: DataFrame, p: MerkleParams) -> DataFrame:
    """(tree, k, path, ...) for the nodes below the lowest level, and for single nodes: siblings up to the tree's root, then `path`
    of `tops` (tree, size, path, ...), which has a row for each tree."""
    rest = [c for c in tops.columns if c not in ("tree", "size", "path")]
    height = F.lit(0)
    for h in range(1, len(levels) + 1):                             # levels above the leaves of a tree
        height = F.when(F.col("size") > p.fanout ** (h - 1), h).otherwise(height)
    tops = tops.withColumn("height", height)
    at = lambda h: tops.where(F.col("height") == h).select("tree", F.lit(0).cast("long").alias("k"), "path", *rest)
    above = at(len(levels))
    for h, level in list(enumerate(levels))[::-1]:
        inner = level.select("tree", "k", *[f"s{i}" for i in range(p.fanout)]).join(above, ["tree", "k"])
        each = ", ".join(f"if(s{i} is null, null, named_struct('k', k * {p.fanout} + {i}, 'own', {siblings(str(i), p)}))" for i in range(p.fanout))
        below = inner.selectExpr("tree", "path", *rest, f"explode(array_compact(array({each}))) as child")
        below = below.selectExpr("tree", "child.k", "concat(array(child.own), path) as path", *rest)
        above = below.unionByName(at(h))
    return above


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, start, lambda d, x: F.sha2(F.concat(x["before"], d, x["after"]), 256))


def proof(path: Column) -> Column:
    """All siblings' digests, from the document to the root, left to right."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), "")


def manifest(docs: DataFrame, p: MerkleParams = MerkleParams(), checked: Column | None = None) -> DataFrame:
    """(doc_id, leaf, seen, subroot, root, path): each document's leaf, roots and siblings.  `seen` is the leaf of what a later
    reader finds, with `checked` in place of the text; if it is not given, the leaf itself."""
    fields = [F.col(c) for c in FIELDS]
    leaf = leaf_digest(*fields)
    seen = leaf if checked is None else F.when(F.col("text").eqNullSafe(checked), F.lit(None)).otherwise(leaf_digest(*fields[:-1], checked))
    key = F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("source").cast("string")))   # null first, then by bytes
    leaves = docs.select("doc_id", key.alias("key"), leaf.alias("digest"), seen.alias("seen"))
    leaves = numbered(stored(leaves, "merkle-leaves"), "key", ["doc_id", "digest"], p)
    sources = leaves.groupBy("key").agg(F.max("size").alias("size")).select("key", F.col("size").alias("docs"), F.lit(0).alias("one"))
    sources = stored(numbered(sources, "one", ["key"], p).select("key", "docs", F.col("k").alias("tree"), F.col("size").alias("trees")), "merkle-sources")
    leaves = stored(leaves.join(sources.select("key", "tree"), "key").select("doc_id", "tree", "size", "k", "digest", "seen"), "merkle-numbered")

    levels = climb(leaves.select("tree", "size", "k", "digest"), p)
    roots = leaves.where("size = 1").select("tree", "digest")
    for level in levels:
        roots = roots.unionByName(level.where("size = 1").select("tree", "digest"))
    roots = stored(sources.join(roots, "tree").select(F.lit(0).alias("tree"), F.col("trees").alias("size"), F.col("tree").alias("k"), "digest", "docs"), "merkle-roots")
    upper = climb(roots.select("tree", "size", "k", "digest"), p)
    root = (upper[-1] if upper else roots).select("digest").first()
    top = roots.select("tree", "size").distinct().withColumn("path", F.expr("cast(array() as array<struct<before:string,after:string>>)"))
    tops = descend(upper, top, p).select(F.col("k"), "path").join(roots.select("k", F.col("docs").alias("size"), F.col("digest").alias("subroot")), "k")
    tops = stored(tops.select(F.col("k").alias("tree"), "size", "path", "subroot"), "merkle-tops")

    alone = leaves.where("size = 1").join(tops.select("tree", "path", "subroot"), "tree").select("doc_id", "digest", "seen", "path", "subroot")
    out = alone
    if levels:                                                      # documents read their own slot of the lowest level
        parents = levels[0].select("tree", "k", *[f"s{i}" for i in range(p.fanout)]).join(descend(levels[1:], _shrunk(tops, p), p), ["tree", "k"])
        own = leaves.where("size > 1").select("doc_id", "tree", "digest", "seen", (F.col("k") % p.fanout).alias("slot"), F.expr(f"k div {p.fanout}").alias("k"))
        path = F.expr(f"concat(array({siblings('slot', p)}), path)")
        out = out.unionByName(own.join(parents, ["tree", "k"]).select("doc_id", "digest", "seen", path.alias("path"), "subroot"))
    return out.select("doc_id", F.col("digest").alias("leaf"), F.coalesce("seen", "digest").alias("seen"), "subroot",
                      F.lit(root[0] if root else None).cast("string").alias("root"), "path")


def _shrunk(tops: DataFrame, p: MerkleParams) -> DataFrame:
    """The same trees without their leaves."""
    return tops.where("size > 1").withColumn("size", F.ceil(F.col("size") / p.fanout))


def verified(found: DataFrame) -> DataFrame:
    """Every document of a manifest folded to the root again, from the leaf that was `seen`."""
    folded = fold(F.col("seen"), F.col("path"))
    out = found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
