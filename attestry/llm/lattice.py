"""Embedding near-duplicates by lattice hashing: random projections decoded to E8 points, cosine checked in double.

Each table projects unit vectors to `blocks` times eight dimensions and decodes
every eight to the nearest point of E8; the points together are the vector's
cell.  A vector also enters the neighbouring cell it is nearest to leaving for.
Members of a cell are compared exactly, and the cell answers with a spanning
forest of its links.  Components of the forests are then compared inside
themselves, tile by tile, which counts each vector's links without a table of
pairs.  A cell or component over `tile` members is split into pairs of tiles,
each a group of its own; nothing is left out.

Equal vectors are one node with a count.  Cosine 0.95 is found in at least one
of eight tables with probability 0.98 for a pair by itself, and links inside a
component need not be found by hashing at all (`tests/llm/test_lattice.py`).

Cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of different lengths never link; a row without an id counts as a
neighbour but names no component; rows that repeat an id are vectors of their
own; extra columns are ignored; an empty table gives an empty table.
"""

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import by_runs, stored
from attestry.llm.components import components


@dataclass(frozen=True)
class LatticeParams:
    cosine: float = 0.95
    tables: int = 8
    blocks: int = 2             # E8 points in a cell; one more for each thousandfold more vectors keeps cells small
    scale: float = 0.5          # standard deviation of a projected coordinate, in lattice units
    seed: int = 7
    tile: int = 2048


def _d8(y: np.ndarray) -> np.ndarray:
    """Nearest point with integer coordinates of even sum."""
    f = np.rint(y)
    off = y - f
    odd = np.nonzero(f.sum(axis=1) % 2 != 0)[0]
    j = np.abs(off[odd]).argmax(axis=1)
    f[odd, j] += np.where(off[odd, j] >= 0, 1.0, -1.0)
    return f


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row: the better of D8 and D8 shifted by a half."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def cells(u: np.ndarray, table: int, p: LatticeParams) -> np.ndarray:
    """(rows, 2) cell ids of unit vectors in one table: the own cell and the nearest neighbouring one."""
    rng = np.random.default_rng([p.seed, table, u.shape[1]])
    x = u @ rng.normal(scale=p.scale, size=(u.shape[1], 8 * p.blocks))
    odd = rng.integers(1, 2 ** 62, size=8 * p.blocks) * 2 + 1
    own, other, cost = [], [], []
    for i in range(p.blocks):
        y = x[:, 8 * i:8 * i + 8]
        c = decode_e8(y)
        away = y - c
        alt = decode_e8(c + away / np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-9))
        own.append(c)
        other.append(alt)
        cost.append(np.where((alt == c).all(axis=1), np.inf, ((y - alt) ** 2).sum(axis=1) - ((y - c) ** 2).sum(axis=1)))
    nearest = np.argmin(np.stack(cost), axis=0)
    probe = np.concatenate([np.where((nearest == i)[:, None], other[i], own[i]) for i in range(p.blocks)], axis=1)
    name = lambda c: (np.rint(c * 2).astype(np.int64) * odd).sum(axis=1)
    return np.stack([name(np.concatenate(own, axis=1)), name(probe)], axis=1)


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _name(values) -> bytes | None:
    """A digest that equal vectors share; None for a vector that can't link."""
    if not values or None in values:
        return None
    v = np.array(values, dtype=np.float64)
    return hashlib.blake2b(v.tobytes(), digest_size=16).digest() if np.isfinite(v).all() and v.any() else None


def _named(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, digest or null) of every row; components stay in the precision they came in."""
    single = vectors.schema["embedding"].dataType.elementType.simpleString() == "float"
    held, kind = (pa.float32(), "float") if single else (pa.float64(), "double")

    def run(batches):
        for batch in batches:
            names = [_name(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.list_(held)), pa.array(names, pa.binary())], ["vec_id", "embedding", "digest"])

    id_kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id {id_kind}, embedding array<{kind}>, digest binary")


def _classes(named: DataFrame) -> DataFrame:
    """(cls, digest, embedding, copies, first_id): one row per distinct usable vector."""
    grouped = named.where("digest is not null").groupBy("digest").agg(
        F.first("embedding").alias("embedding"), F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    return grouped.withColumn("cls", F.monotonically_increasing_id())


def _tiled(rows: DataFrame, sizes: DataFrame, keys: list[str], tile: int) -> DataFrame:
    """Join the sizes of groups of at least two members, and put each row in every pair of tiles that its own tile is in."""
    big = sizes.where("members > 1").select(*keys, F.ceil(F.col("members") / tile).cast("int").alias("tiles"))
    rows = rows.join(big, keys).withColumn("mine", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, F.col("mine")).alias("t1"), F.greatest(t, F.col("mine")).alias("t2")))
    return rows.withColumn("t", F.explode(pairs)).select("*", "t.t1", "t.t2").drop("t", "tiles")


def _unit(column) -> np.ndarray:
    v = _matrix(column)
    v = v / np.abs(v).max(axis=1, keepdims=True)        # so that the norm can't overflow
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _forest(cosine: float):
    def answer(t: pa.Table):
        cls = t.column("cls").to_numpy()
        cls, first = np.unique(cls, return_index=True)  # a vector may enter a cell as its own and as a neighbour
        if len(cls) < 2:
            return None
        u = _unit(t.column("embedding"))[first]
        label = np.arange(len(cls))
        for i in range(0, len(cls), 512):
            near = u[i:i + 512] @ u.T >= cosine
            for k in np.nonzero(near.sum(axis=1) > 1)[0]:
                groups = np.unique(label[near[k]])
                if len(groups) > 1:
                    label[np.isin(label, groups[1:])] = groups[0]
        at = np.nonzero(label != np.arange(len(cls)))[0]
        return pa.table({"a": pa.array(cls[label[at]]), "b": pa.array(cls[at])}) if len(at) else None

    return answer


def _counts(cosine: float):
    def answer(t: pa.Table):
        cls, copies, mine = (t.column(c).to_numpy() for c in ("cls", "copies", "mine"))
        t1, t2 = t.column("t1")[0].as_py(), t.column("t2")[0].as_py()
        u = _unit(t.column("embedding"))
        left, right = np.nonzero(mine == t1)[0], np.nonzero(mine == t2)[0]
        n = np.zeros(len(cls), np.int64)
        for i in range(0, len(left), 512):
            own = left[i:i + 512]
            near = u[own] @ u[right].T >= cosine
            if t1 == t2:
                near[own[:, None] == right[None, :]] = False
            n[own] += near @ copies[right]
            if t1 != t2:
                n[right] += copies[own] @ near
        return pa.table({"cls": pa.array(cls), "links": pa.array(n)})

    return answer


def near_vectors(vectors: DataFrame, p: LatticeParams = LatticeParams()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding)."""
    named = stored(_named(vectors), "vectors")
    classes = stored(_classes(named), "vector-classes")
    tables = p.tables

    def place(batches):
        for batch in batches:
            lengths = np.array([len(x) for x in batch.column(1)])
            for d in np.unique(lengths):
                part = batch.take(pa.array(np.nonzero(lengths == d)[0]))
                u, n = _unit(part.column(1)), part.num_rows
                at = [cells(u, t, p) for t in range(tables)]
                for t in range(tables):
                    rows = np.nonzero(at[t][:, 1] != at[t][:, 0])[0]
                    index = np.concatenate([np.arange(n), rows])
                    cell = np.concatenate([at[t][:, 0], at[t][rows, 1]])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(index), t * 1_000_000 + int(d), np.int64)), pa.array(cell), part.column(0).take(pa.array(index))],
                                                     ["grid", "cell", "cls"])

    # cells are counted by name; only vectors that share one travel to it
    entries = stored(classes.select("cls", "embedding").mapInArrow(place, "grid long, cell long, cls long"), "vector-cells")
    sizes = entries.groupBy("grid", "cell").agg(F.count("*").alias("members"))
    members = _tiled(entries, sizes, ["grid", "cell"], p.tile).select("grid", "cell", "t1", "t2", "cls").join(classes.select("cls", "embedding"), "cls")
    edges = by_runs(members, ["grid", "cell", "t1", "t2"], _forest(p.cosine), "a long, b long")
    groups = stored(components(edges), "vector-components")

    inside = classes.select("cls", "embedding", "copies").join(groups.withColumnRenamed("node", "cls"), "cls")
    sizes = groups.groupBy("component").agg(F.count("*").alias("members"))
    members = _tiled(inside, sizes, ["component"], p.tile).select("component", "t1", "t2", "cls", "embedding", "copies", "mine")
    counted = by_runs(members, ["component", "t1", "t2"], _counts(p.cosine), "cls long, links long").groupBy("cls").agg(F.sum("links").alias("links"))

    whole = classes.select("cls", "digest", "copies", "first_id").join(groups.withColumnRenamed("node", "cls"), "cls", "left").join(counted, "cls", "left")
    whole = whole.withColumn("component", F.coalesce("component", "cls"))
    lowest = whole.groupBy("component").agg(F.min("first_id").alias("lowest"))
    whole = whole.join(lowest, "component").select("digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "lowest")
    out = named.select("vec_id", "digest").join(whole, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("lowest"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.col("vec_id").eqNullSafe(component).alias("kept"))
