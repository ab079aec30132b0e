"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of at least `least`, each link verified.

Texts with equal sets are one node.  Nodes meet in buckets: `bands` keys of
`rows` min-hashes each, so that a pair at 0.8 shares no key with probability
(1 - 0.8 ** rows) ** bands, below one in a million.

Pairs are verified where they meet, on the whole sets, and a bucket answers with
a spanning forest of its links: no table of pairs exists, and a crowd of similar
texts below `least` gives no rows at all.  A bucket of more than `tile` nodes or
`load` shingles is dealt into tiles.

First round: each node in the largest of its buckets only, each tile by itself;
a bucket of several tiles is dealt into them more than once, each time anew, so
that large groups of copies are connected at a cost in proportion to their size.
Second round: all bands and all pairs of tiles, but
only buckets whose nodes are not all connected yet, in the first bucket that a
pair shares, and only pairs whose sketches (a byte of every min-hash) are not far
(six standard deviations) below `least`.

In both rounds only nodes with a pair that the sketches allow send sets, and
the first bytes of the sketches (hints) already tell most unrelated nodes of a
bucket apart: as tables grow, chance meetings grow faster than they do, and must
cost few bytes.

Cases: a null text is empty; texts without words have the empty set and are
copies of each other; texts of less than five words are one shingle; rows
without an id link like others; extra columns are ignored; an empty table gives
an empty table.
"""

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.common import by_runs, stored
from attestry.llm.components import components
from attestry.llm.simhash import _LOWER, SimHashParams, fingerprint
from attestry.llm.simhash import links as simhash_links
from attestry.llm.tokens import parts


@dataclass(frozen=True)
class NearParams:
    shingle: int = 5
    least: float = 0.8
    seed: int = 42
    rows: int = 0               # min-hashes in a key; 0: by the number of documents
    bands: int = 0              # keys of a text
    deals: int = 2              # times that a large bucket is dealt into tiles in the first round
    tile: int = 512             # nodes of a bucket that are compared in one group
    load: int = 1_000_000       # shingles of a bucket that are compared in one group
    hint: int = 32              # bytes of a sketch that meet first
    sieve: int = 2 ** 26        # bits of the map that tells which texts may be wanted


def for_rows(p: NearParams, n: int) -> NearParams:
    """Longer keys, and more of them, for more documents: unrelated texts must not fill the buckets."""
    if p.rows:
        return p
    return replace(p, rows=4, bands=28) if n < 10 ** 7 else replace(p, rows=5, bands=36) if n < 10 ** 9 else replace(p, rows=6, bands=46)


def shingles(text: str | None, p: NearParams = NearParams()) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of lower-cased words."""
    from xxhash import xxh64_intdigest as h

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - p.shingle + 1)
    joined, seed = b" ".join(words), p.seed
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:n - 1])).tolist()
    stops = (ends[len(words) - n:] - 1).tolist()
    return np.unique(np.fromiter((h(joined[a:b], seed) for a, b in zip(starts, stops)), np.uint64, n))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; two empty sets are equal."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _mixers(p: NearParams) -> np.ndarray:
    return np.random.default_rng(p.seed).integers(1, 2 ** 63, (2, p.rows * p.bands), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _min_hashes(own: np.ndarray, mixers: np.ndarray) -> np.ndarray:
    """The smallest of the set under each mixer."""
    low = np.full(mixers.shape[1], np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(own), 512):
        low = np.minimum(low, ((own[None, at:at + 512] ^ mixers[0][:, None]) * mixers[1][:, None]).min(axis=1))
    return low


def signatures(docs: DataFrame, p: NearParams, bits: SimHashParams | None = None) -> DataFrame:
    """(doc_id, text_key, node, size, keys, sketch, fp): the set's name (128 bits) and size, its bucket keys, a byte of each min-hash,
    and, if `bits` are given, the text's SimHash."""

    def run(batches):
        from xxhash import xxh64_intdigest as h

        mixers = _mixers(p)
        with np.errstate(over="ignore"):
            for batch in parts(batches):
                nodes, sizes, keys, sketches, fps = [], [], [], [], []
                for t in batch.column(1):
                    own = shingles(t.as_py(), p)
                    low = _min_hashes(own, mixers)
                    nodes.append(_name(own))
                    sizes.append(len(own))
                    keys.append(np.array([h(band.tobytes(), i) for i, band in enumerate(low.reshape(p.bands, p.rows))], np.uint64).view(np.int64))
                    fps.append(fingerprint(t.as_py(), bits) if bits else None)
                    sketches.append((low & np.uint64(255)).astype(np.uint8).tobytes())     # the high bits of a minimum say little
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()),
                                                  pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary()),
                                                  pa.array(fps, pa.uint64()).view(pa.int64())],
                                                 ["doc_id", "text_key", "node", "size", "keys", "sketch", "fp"])

    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, node binary, size long, keys array<long>, sketch binary, fp long"
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, kind)


def _name(own: np.ndarray) -> bytes:
    from xxhash import xxh128_digest

    return xxh128_digest(own.tobytes())


def _sieved(docs: DataFrame, key: str, wanted: DataFrame, p: NearParams) -> DataFrame:
    """`docs` with the column `__maybe`: false only where the hash `key` is surely not among the hashes `wanted`.

    Whole texts are the largest column and few of them are wanted: the others need not be shuffled to find that out.  The wanted
    hashes become a bitmap of at most `sieve` bits, in pieces of 4 KB that go to all tasks; a fuller bitmap lets more rows pass,
    and an exact join follows."""
    width = 2 ** 15
    least = min(16 * wanted.count(), p.sieve)
    while width < least:
        width *= 2
    at = F.pmod(wanted.columns[0], F.lit(width))
    bits = wanted.select(F.shiftright(at, 15).alias("__piece"), at.bitwiseAND(F.lit(32767)).alias("at")).groupBy("__piece").agg(
        F.bitmap_construct_agg("at").alias("__bits"))
    at = F.pmod(key, F.lit(width))
    place = at.bitwiseAND(F.lit(32767))
    byte = F.conv(F.hex(F.substr("__bits", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = docs.withColumn("__piece", F.shiftright(at, 15)).join(F.broadcast(bits), "__piece", "left")
    power = F.pow(F.lit(2), place.bitwiseAND(F.lit(7))).cast("int")
    return marked.withColumn("__maybe", F.coalesce(byte.bitwiseAND(power) > 0, F.lit(False))).drop("__piece", "__bits")


def _sets(docs: DataFrame, needed: DataFrame, p: NearParams) -> DataFrame:
    """(node, hashes): the whole shingle sets of `needed` (node, rep_id, text_key), each read from the one row that stands for it."""
    texts = docs.select(F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("key"))
    texts = _sieved(texts, "key", needed.select("text_key"), p).where("__maybe").drop("__maybe")
    met = texts.join(needed, F.col("id").eqNullSafe(F.col("rep_id")) & (F.col("key") == F.col("text_key")))
    met = met.groupBy("node").agg(F.first("text").alias("text"))        # rows may repeat

    def run(batches):
        for batch in parts(batches, 500):
            own = [shingles(t.as_py(), p) for t in batch.column(1)]
            if any(n.as_py() != _name(x) for n, x in zip(batch.column(0), own)):
                raise ValueError("two texts share a 64-bit key: choose another seed")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in own], pa.binary())], ["node", "hashes"])

    return met.mapInArrow(run, "node binary, hashes binary")


def _tiles(members: DataFrame, p: NearParams) -> DataFrame:
    """(key, n, tiles) of the buckets whose nodes are not all of one group."""
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("load"), F.min("group").alias("g1"), F.max("group").alias("g2"))
    return sizes.where("n > 1 and g1 <> g2").select("key", "n", F.greatest(F.ceil(F.col("n") / p.tile), F.ceil(F.col("load") / p.load)).cast("int").alias("tiles"))


def _alike_bytes(sketches: np.ndarray, p: NearParams) -> np.ndarray:
    """Pairs whose sketches, or parts of them, allow `least`."""
    size = sketches.shape[1]
    floor = size * p.least - 6.5 * np.sqrt(size * p.least * (1 - p.least))
    out = np.zeros((len(sketches), len(sketches)), bool)
    step = max(1, 4_000_000 // (len(sketches) * size))
    for at in range(0, len(sketches), step):
        out[at:at + step] = (sketches[at:at + step, None] == sketches[None]).sum(axis=2, dtype=np.int32) >= floor
    return out


def _allowed(sketches: np.ndarray, keys: np.ndarray, band: int, p: NearParams) -> np.ndarray:
    """Pairs whose sketches allow `least` and that share no earlier bucket."""
    out = _alike_bytes(sketches, p)
    step = max(1, 4_000_000 // (len(sketches) * max(band, 1)))
    for at in range(0, len(sketches), step):
        out[at:at + step] &= ~(keys[at:at + step, None, :band] == keys[None, :, :band]).any(axis=2)
    return out


def forest(sets: list[np.ndarray], group: np.ndarray, allowed: np.ndarray | None, least: float) -> list[tuple[int, int]]:
    """Pairs (i, k) that connect what the pairs at `least` or more connect beyond the groups given; all pairs are allowed, or those marked."""
    sizes = np.array([len(x) for x in sets])
    group, edges = group.copy(), []
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    mark = np.zeros(int(ids.max(initial=-1)) + 1, np.int64)
    for i in range(len(sets)):
        todo = (group != group[i]) & (np.minimum(sizes, sizes[i]) / np.maximum(np.maximum(sizes, sizes[i]), 1) >= least)
        todo[:i + 1] = False
        if allowed is not None:
            todo &= allowed[i]
        if not todo.any():
            continue
        own = ids[ends[i] - sizes[i]:ends[i]]
        mark[own] = 1
        both = np.bincount(owner, mark[ids], minlength=len(sets))
        mark[own] = 0
        for k in np.nonzero(todo & (both / np.maximum(sizes + sizes[i] - both, 1) >= least))[0].tolist():
            if group[k] != group[i]:
                edges.append((i, k))
                group[group == group[k]] = group[i]
    return edges


def _numbers(column) -> np.ndarray:
    return column.combine_chunks().dictionary_encode().indices.to_numpy()


def _linked(rows: DataFrame, p: NearParams, sketched: bool) -> DataFrame:
    """Links (a, b: node) of rows (key, t1, t2, node, group, hashes and, in the second round, band, mine, keys, sketch)."""

    def answer(t):
        if t.num_rows < 2:
            return None
        group, allowed = _numbers(t.column("group")), None
        if sketched:
            allowed = _pairs(t, p)
        sets = [np.frombuffer(x, np.uint64) for x in t.column("hashes").to_pylist()]
        edges = forest(sets, group, allowed, p.least)
        if not edges:
            return None
        node = t.column("node").combine_chunks()
        a, b = zip(*edges)
        return pa.table({"a": node.take(pa.array(a)), "b": node.take(pa.array(b))})

    return by_runs(rows, ["key", "t1", "t2"], answer, "a binary, b binary")


def _pairs(t, p: NearParams) -> np.ndarray:
    """What the second round compares in a group of rows: pairs of different groups, between the two tiles."""
    sketches = _bytes(t, "sketch")
    keys = t.column("keys").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
    mine, group = t.column("mine").to_numpy(), _numbers(t.column("group"))
    ok = _allowed(sketches, keys, t.column("band")[0].as_py(), p) & (group[:, None] != group[None])
    if t.column("t1")[0] != t.column("t2")[0]:
        ok &= mine[:, None] != mine[None]
    return ok


def _bytes(t, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(name).to_pylist()), np.uint8).reshape(t.num_rows, -1)


def _hinted(rows: DataFrame, p: NearParams) -> DataFrame:
    """The rows that have a pair which hints allow in their group: of different groups of nodes and, where `mine` is given, between two tiles."""

    def answer(t):
        if t.num_rows < 2:
            return None
        group, mine = _numbers(t.column("group")), t.column("mine")
        if (group == group[0]).all():
            return None
        ok = _alike_bytes(_bytes(t, "hint"), p) & (group[:, None] != group[None])
        if mine.null_count == 0 and t.column("t1")[0] != t.column("t2")[0]:
            ok &= mine.to_numpy()[:, None] != mine.to_numpy()[None]
        some = ok.any(axis=1)
        return t.drop_columns(["hint"]).filter(pa.array(some)) if some.any() else None

    return by_runs(rows.select("key", "t1", "t2", "node", "group", "band", "mine", "hint"), ["key", "t1", "t2"], answer,
                   "key long, t1 int, t2 int, node binary, group binary, band int, mine int")


def _asked(rows: DataFrame, p: NearParams) -> DataFrame:
    """The rows that have a pair to verify in their group."""

    def answer(t):
        some = _pairs(t, p).any(axis=1) if t.num_rows > 1 else np.zeros(t.num_rows, bool)
        return t.filter(pa.array(some)) if some.any() else None

    return by_runs(rows, ["key", "t1", "t2"], answer, "key long, t1 int, t2 int, node binary, group binary, band int, mine int, keys array<long>, sketch binary")


def _alike(marked: DataFrame, bits: SimHashParams) -> DataFrame:
    """Links (a, b: node) that connect what SimHash within its radius connects: each node with the first of its group."""
    pairs = marked.select("node", "fp").distinct()
    groups = components(simhash_links(stored(pairs.select("fp").distinct(), "near-bits"), bits)).withColumnRenamed("node", "fp")
    named = pairs.join(groups, "fp", "left").select("node", F.coalesce("component", "fp").alias("of"))
    lowest = named.groupBy("of").agg(F.min("node").alias("a"))
    return named.join(lowest, "of").where("node <> a").select("a", F.col("node").alias("b")).distinct()


def near_copies(docs: DataFrame, p: NearParams = NearParams(), bits: SimHashParams | None = None) -> DataFrame:
    """(doc_id, text_key, node, component, component_id): component_id is the smallest id reachable over verified links and, if `bits`
    are given, over those of SimHash; the row's own included."""
    p = for_rows(p, docs.count())
    marked = stored(signatures(docs, p, bits), "near-signatures")
    nodes = stored(marked.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "text_key")).alias("rep"), F.first("size").alias("size"),
                                              F.first("keys").alias("keys"), F.first("sketch").alias("sketch")), "near-nodes")
    # buckets are found by half of a node's name; the few members of shared ones then get the whole name
    half = F.conv(F.substring(F.hex("node"), 1, 15), 16, 10).cast("long")
    spread = nodes.select(half.alias("half"), F.posexplode("keys").alias("band", "key"))
    shared = spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    met = stored(spread.join(shared, "key"), "near-met")
    names = nodes.select(half.alias("half"), "node", "size", F.substring("sketch", 1, p.hint).alias("hint"))
    needed = met.select("half").distinct().join(names, "half")
    members = met.join(needed, "half").select("node", "size", "hint", F.col("node").alias("group"), "band", "key")
    members = stored(members, "near-members")

    def sets_of(rows):
        wanted = rows.select("node").distinct().join(nodes.select("node", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_key").alias("text_key")), "node")
        return stored(_sets(docs, stored(wanted, "near-needed"), p), "near-sets")

    early = members.join(_tiles(members, p), "key").groupBy("node").agg(F.max(F.struct("n", "key", "tiles", "hint")).alias("b"))
    early = early.select("node", F.col("node").alias("group"), "b.key", "b.tiles", "b.hint", F.explode(
        F.when(F.col("b.tiles") > 1, F.sequence(F.lit(1), F.lit(p.deals))).otherwise(F.array(F.lit(1)))).alias("t2"))
    early = early.withColumn("t1", F.pmod(F.xxhash64("node", "t2"), F.col("tiles")).cast("int"))
    early = early.withColumn("band", F.lit(0)).withColumn("mine", F.lit(None).cast("int"))
    early = stored(_hinted(early, p), "near-early")
    sets = sets_of(early)
    links = stored(_linked(early.select("key", "t1", "t2", "node", "group").join(sets, "node"), p, False), "near-links")
    if bits:
        links = links.union(stored(_alike(marked, bits), "near-alike"))

    named = members.drop("group").join(components(links), "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component")
    named = stored(named, "near-named")
    late = named.join(_tiles(named, p), "key").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    both = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, F.col("mine")).alias("t1"), F.greatest(t, F.col("mine")).alias("t2")))
    late = late.withColumn("t", F.explode(both)).select("key", "t.t1", "t.t2", "node", "group", "band", "mine", "hint")
    late = stored(_hinted(late, p), "near-late").join(nodes.select("node", "keys", "sketch"), "node")
    asked = stored(_asked(late.select("key", "t1", "t2", "node", "group", "band", "mine", "keys", "sketch"), p), "near-asked")
    sets = sets.union(sets_of(asked.join(sets.select("node"), "node", "left_anti")))
    links = links.union(stored(_linked(asked.join(sets, "node"), p, True), "near-more"))

    found = nodes.select("node", "first_id").join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = found.groupBy("component").agg(F.min("first_id").alias("component_id"))
    found = stored(found.join(lowest, "component").select("node", "component", "component_id"), "near-components")
    return marked.select("doc_id", "text_key", "node").join(found, "node")


def one_of_each(docs: DataFrame, p: NearParams = NearParams(), bits: SimHashParams | None = None) -> DataFrame:
    """The documents without near copies: of each group the row with the smallest id stays (of rows with that id, one of those
    whose text has the smallest key); rows without an id stay, as no group can name them.  Only texts that may go or repeat are shuffled."""
    names = docs.columns
    rows = near_copies(docs, p, bits).where("doc_id is not null").groupBy("doc_id", "text_key", "component", "component_id").agg(F.count("*").alias("n"))
    first = rows.where("doc_id = component_id").groupBy("component").agg(F.min("text_key").alias("kept"))
    rows = rows.join(first, "component")
    marks = stored(rows.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("n").alias("__n"), (
        (F.col("doc_id") == F.col("component_id")) & (F.col("text_key") == F.col("kept"))).alias("__stays")).where("not __stays or __n > 1"), "near-rows")
    sieved = _sieved(docs.withColumn("__text_key", F.xxhash64("text")), "__text_key", marks.select("__key"), p)
    met = sieved.where("__maybe").join(marks, (F.col("doc_id") == F.col("__id")) & (F.col("__text_key") == F.col("__key")), "left")
    met = met.where("__n is null or __stays")
    # the join has dealt and sorted the rows as this window needs them; a row that nothing marks is counted by itself
    own = Window.partitionBy("doc_id", "__text_key").orderBy("__n")
    met = met.withColumn("__place", F.row_number().over(own)).where("__n is null or __place = 1").select(*names)
    return sieved.where("not __maybe").select(*names).union(met)
