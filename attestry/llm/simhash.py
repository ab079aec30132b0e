"""SimHash near-duplicates: 64-bit fingerprints of word shingles, compared as bit planes.

Fingerprints within `radius` bits agree in at least one of radius + 1 blocks of
bits, so each distinct fingerprint goes to one bucket per block.  A bucket is
held vertically (plane j has bit j of all its fingerprints): a query is XORed
with plane after plane, carry-save counters add the differing bits of 64
fingerprints at a time, and a block of them is given up once all counters are
past the radius.  A bucket answers with a spanning forest, not with its pairs:
it connects what its links connect, with fewer edges than members.

A bucket over `tile` members is compared tile against tile, each pair of tiles
in a group of its own, so no group grows with the data; nothing is left out.

Cases: a null text is empty; texts without words have fingerprint zero and link
like others; texts of one or two words are one shingle; equal fingerprints are
one node, however many rows share them; rows without an id get a fingerprint
and their group's smallest id (null if it has none); extra columns are ignored;
an empty table gives an empty table.
"""

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import stored
from attestry.llm.components import components

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_LANES = 16                     # 64-bit words in a block of lanes


@dataclass(frozen=True)
class SimHashParams:
    shingle: int = 3
    radius: int = 3
    seed: int = 42
    tile: int = 4096            # members of a bucket that are compared in one group


def fingerprint(text: str | None, p: SimHashParams = SimHashParams()) -> int:
    """Bit i is 1 if it is set in over half of the shingles' hashes, repeats included."""
    from xxhash import xxh64_intdigest as h

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - p.shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:n - 1])).tolist()
    stops = (ends[len(words) - n:] - 1).tolist()
    votes, seed = np.zeros(64, dtype=np.int64), p.seed
    for i in range(0, n, 65536):
        hashes = np.array([h(joined[a:b], seed) for a, b in zip(starts[i:i + 65536], stops[i:i + 65536])], dtype="<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, p: SimHashParams = SimHashParams()) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            fps = np.array([fingerprint(t.as_py(), p) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _within(planes: np.ndarray, bits: np.ndarray, radius: int) -> np.ndarray:
    """Lanes within the radius of each query, as bytes of lane bits.  planes: (64, blocks, _LANES); bits: (queries, 64)."""
    queries, blocks = len(bits), planes.shape[1]
    flip = np.where(bits, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
    q, b = (x.ravel() for x in np.divmod(np.arange(queries * blocks), blocks))
    counters = [np.zeros((len(q), _LANES), np.uint64) for _ in range(radius.bit_length())]
    past = np.zeros((len(q), _LANES), np.uint64)
    for j in range(64):
        carry = planes[j][b] ^ flip[q, j][:, None]
        for k, c in enumerate(counters):
            counters[k], carry = c ^ carry, c & carry
        past |= carry
        if j >= 11 and j % 4 == 3:
            live = (past != np.uint64(0xFFFFFFFFFFFFFFFF)).any(axis=1)
            if not live.all():                                      # the other blocks are given up
                q, b, past, counters = q[live], b[live], past[live], [c[live] for c in counters]
                if not len(q):
                    break
    hit = np.zeros((queries, blocks, _LANES), np.uint64)
    if len(q):
        equal, less = np.full(past.shape, np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(past.shape, np.uint64)
        for k in range(len(counters) - 1, -1, -1):                  # counters <= radius, from the highest digit
            if radius >> k & 1:
                less |= equal & ~counters[k]
                equal &= counters[k]
            else:
                equal &= ~counters[k]
        hit[q, b] = ~past & (less | equal)
    return hit.reshape(queries, -1)


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (root, member) that connect what pairs within the radius connect."""
    fps = np.unique(fps.astype(np.uint64))
    n = len(fps)
    lanes = -(-n // (64 * _LANES)) * 64 * _LANES
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    full = np.zeros((64, lanes), np.uint8)
    full[:, :n] = bits.T
    planes = np.packbits(full, axis=1, bitorder="little").view(np.uint64).reshape(64, -1, _LANES)
    label = np.arange(n)
    step = max(16, 65536 * 4 // max(lanes // 64, 1) // 16)
    for i in range(0, n, step):
        hits = _within(planes, bits[i:i + step], radius)
        for k in np.nonzero(np.bitwise_count(hits).sum(axis=1) > 1)[0]:
            members = np.nonzero(np.unpackbits(hits[k].view(np.uint8), bitorder="little", count=n))[0]
            groups = np.unique(label[members])
            if len(groups) > 1:
                label[np.isin(label, groups[1:])] = groups[0]
    members = np.nonzero(label != np.arange(n))[0]
    return fps[label[members]], fps[members]


def blocks_for(n: int, radius: int, tile: int) -> tuple[int, int]:
    """(number of blocks, bits of a key): blocks of which radius + 1 or more must agree are joined into keys; more and
    longer keys as the number of fingerprints grows, so that a bucket stays near the tile size."""
    want = max(1, math.ceil(math.log2(max(2, 2 * n / tile))))
    blocks = radius + 1
    while 64 // blocks * (blocks - radius) < want and blocks < radius + 5:
        blocks += 1
    return blocks, min(want, 64 // blocks * (blocks - radius))


def _keys(blocks: int, radius: int, bits: int) -> list:
    """A key for each choice of blocks that may agree: their bits side by side, the first `bits` of them."""
    from itertools import combinations

    width, keys = 64 // blocks, []
    for chosen in combinations(range(blocks), blocks - radius):
        key, held = F.lit(0).cast("long"), 0
        for c in chosen:
            take = min(width, bits - held)
            if take > 0:
                key = F.shiftleft(key, take).bitwiseOR(F.shiftrightunsigned("fp", c * width).bitwiseAND(F.lit((1 << take) - 1)))
                held += take
        keys.append(key)
    return keys


def links(fps: DataFrame, p: SimHashParams = SimHashParams()) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fp` that connect exactly what distances up to the radius connect."""
    n = fps.count()
    keys = _keys(*[(b, p.radius, k) for b, k in [blocks_for(n, p.radius, p.tile)]][0])
    spread = fps.select("fp", F.posexplode(F.array(*keys)).alias("block", "key"))
    sizes = spread.groupBy("block", "key").agg(F.count("*").alias("members")).where("members > 1")
    big = sizes.select("block", "key", F.ceil(F.col("members") / p.tile).cast("int").alias("tiles"))
    spread = spread.join(big, ["block", "key"])
    mine = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, F.col("mine")).alias("t1"), F.greatest(t, F.col("mine")).alias("t2")))
    tiled = spread.withColumn("mine", mine).select("fp", "block", "key", F.explode(pairs).alias("t")).select("fp", "block", "key", "t.t1", "t.t2")
    radius = p.radius

    def compare(batch):
        a, b = forest(batch.column("fp").to_numpy().view(np.uint64), radius)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return tiled.groupBy("block", "key", "t1", "t2").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, p: SimHashParams = SimHashParams()) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id reachable over links, the row's own included."""
    marked = stored(fingerprints(docs, p), "simhash")
    first = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    groups = components(links(first.select("fp"), p)).withColumnRenamed("node", "fp")
    named = first.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(lowest, "component").select("fp", "component_id")
    return marked.join(named, "fp")


def one_of_each(docs: DataFrame, p: SimHashParams = SimHashParams()) -> DataFrame:
    """The documents without near-duplicates: of each group the row with the smallest id stays (one row, if rows repeat
    it); rows without an id stay, as no group can name them."""
    names = docs.columns
    groups = near_duplicates(docs, p)
    first = groups.where("doc_id is not null and doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    kept = docs.join(first, F.col("doc_id") == F.col("__kept")).dropDuplicates(["__kept"]).select(*names)
    return kept.union(docs.where("doc_id is null").select(*names))
