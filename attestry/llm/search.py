"""Exact top-k by inner product of integer vectors: tiled matrix products, partial selection, merging by tree.

Rows are packed into blocks where they lie, in the narrowest integers that hold
them; query blocks go to every lane of candidate blocks, by a shuffle: the
copies are many times the table that Spark's size check sees.  A tile is one matrix product; of it each query keeps its k
best, running over the candidate blocks of a lane.  Lists of different lanes
are merged `fan_in` at a time, so no task sees more than that many lists.
Products are exact: in single or double floating point where no sum can leave
the integers they hold, in 64-bit integers otherwise.

Cases: vectors that are null, empty or hold null or non-finite components and
rows without an id take no part; only vectors of one length are compared; a
query is left out of its own list by its row, so a repeated id stays a
candidate; ties go to the smaller id; extra columns are ignored; an empty table
gives an empty table.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import stored


@dataclass(frozen=True)
class TopKParams:
    k: int = 20
    scale: float = 64.0
    block: int = 4096           # candidates in a block
    queries: int = 1024         # queries in a block
    lane: int = 4               # candidate blocks in a lane; more where `lanes` lanes would not hold all
    lanes: int = 128            # so often is a query sent at most
    fan_in: int = 16


_BLOCK = "dim int, ids binary, points binary"
_LIMIT = 2.0 ** 62


def _quantised(values, scale: float) -> np.ndarray | None:
    """floor(scale * x) of each component; None if the vector takes no part."""
    if not values or None in values:
        return None
    v = np.floor(np.array(values, dtype=np.float64) * scale)
    return np.clip(v, -_LIMIT, _LIMIT).astype(np.int64) if np.isfinite(v).all() else None


def _narrow(points: np.ndarray) -> bytes:
    top = max(-int(points.min(initial=0)) - 1, int(points.max(initial=0)))
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if top <= np.iinfo(t).max)
    return np.ascontiguousarray(points, kind).tobytes()


def _wide(data: bytes, rows: int, dim: int) -> np.ndarray:
    """The vectors that `_narrow` packed, as 64-bit integers."""
    return np.frombuffer(data, f"i{len(data) // (rows * dim)}").reshape(rows, dim).astype(np.int64)


def _packed(rows: list) -> pa.RecordBatch:
    """One block of (id, is query, vector) with vectors of one length."""
    ids = np.array([r[0] for r in rows], np.int64)
    points = np.stack([r[2] for r in rows])
    return pa.RecordBatch.from_arrays([pa.array([points.shape[1]], pa.int32()), pa.array([ids.tobytes()], pa.binary()),
                                       pa.array([_narrow(points)], pa.binary()), pa.array([np.array([r[1] for r in rows], bool).tobytes()], pa.binary())],
                                      ["dim", "ids", "points", "is_query"])


def _blocks(vectors: DataFrame, is_query: Column, p: TopKParams) -> DataFrame:
    def pack(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for i, q, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                x = _quantised(v.as_py(), p.scale)
                if i is not None and x is not None:
                    own = held.setdefault(len(x), [])
                    own.append((i, bool(q), x))
                    if len(own) == p.block:
                        yield _packed(held.pop(len(x)))
        for own in held.values():
            yield _packed(own)

    rows = vectors.select(F.col("vec_id").cast("long"), F.coalesce(is_query, F.lit(False)), "embedding")
    return stored(rows.mapInArrow(pack, _BLOCK + ", is_query binary").withColumn("block", F.monotonically_increasing_id()), "search-blocks")


def _query_blocks(blocks: DataFrame, p: TopKParams) -> DataFrame:
    """Blocks of query rows; `home` and `place` say which row of which candidate block a query is."""

    def gather(batches):
        held: dict[int, list] = {}

        def made(dim):
            own = held.pop(dim)
            ids, points, home, place = (np.concatenate([x[c] for x in own]) for c in range(4))
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *[pa.array([c], pa.binary()) for c in (ids.tobytes(), _narrow(points), home.tobytes(), place.tobytes())]],
                                              ["dim", "ids", "points", "home", "place"])

        for batch in batches:
            for r in batch.to_pylist():
                asked = np.frombuffer(r["is_query"], bool)
                at = np.nonzero(asked)[0]
                points = _wide(r["points"], len(asked), r["dim"])
                for a in range(0, len(at), p.queries):
                    part = at[a:a + p.queries]
                    own = held.setdefault(r["dim"], [])
                    own.append((np.frombuffer(r["ids"], np.int64)[part], points[part], np.full(len(part), r["block"], np.int64), part.astype(np.int64)))
                    if sum(len(x[0]) for x in own) >= p.queries:
                        yield made(r["dim"])
        for dim in list(held):
            yield made(dim)

    rows = blocks.mapInArrow(gather, _BLOCK + ", home binary, place binary")
    return stored(rows.withColumn("query_block", F.monotonically_increasing_id()), "search-queries")


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows (sums within 64 bits)."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if bound < 2 ** 24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if bound < 2 ** 53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest of each row, ties to the smaller id; ids: one row of candidates for all, or one per row."""
    ids = np.broadcast_to(ids, scores.shape)
    if scores.shape[1] > k:
        edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None]
        width = int((scores >= edge).sum(axis=1).max())          # k and the ties at the edge
        if width <= max(4 * k, 256):
            at = np.argpartition(-scores, width - 1, axis=1)[:, :width] if width < scores.shape[1] else None
            if at is not None:
                scores, ids = np.take_along_axis(scores, at, 1), np.take_along_axis(ids, at, 1)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


_LIST = "query_block long, lane int, ids binary, found binary, scores binary"
_NONE = -np.iinfo(np.int64).max     # marks a place in a list that nothing fills


def _list(block: int, lane: int, ids: np.ndarray, found: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([lane], pa.int32()), *[pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (ids, found, scores)]],
                                      ["query_block", "lane", "ids", "found", "scores"])


def _tiles(queries: DataFrame, blocks: DataFrame, lanes: int, p: TopKParams) -> DataFrame:
    def run(batches):
        key, held = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if key != (r["query_block"], r["lane"]):
                    if held is not None:
                        yield _list(*key, *held)
                    key, held = (r["query_block"], r["lane"]), None
                    ids = np.frombuffer(r["ids"], np.int64)
                    q = _wide(r["points"], len(ids), r["dim"])
                    home, place = np.frombuffer(r["home"], np.int64), np.frombuffer(r["place"], np.int64)
                c_ids = np.frombuffer(r["c_ids"], np.int64)
                c = _wide(r["c_points"], len(c_ids), r["dim"])
                scores = products(q, c)
                own = np.nonzero(home == r["block"])[0]
                scores[own, place[own]] = _NONE
                best, found = best_of(scores, c_ids, p.k)
                if held is not None:
                    best, found = best_of(np.concatenate([held[2], best], axis=1), np.concatenate([held[1], found], axis=1), p.k)
                held = (ids, found, best)
        if held is not None:
            yield _list(*key, *held)

    spread = queries.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    dealt = blocks.select(F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int").alias("lane"), "dim", "block", F.col("ids").alias("c_ids"), F.col("points").alias("c_points"))
    # never by broadcast: the copies of the queries would pass through the driver
    return spread.hint("merge").join(dealt, ["lane", "dim"]).select("query_block", "lane", "dim", "ids", "points", "home", "place", "block", "c_ids", "c_points").mapInArrow(run, _LIST)


def _merged(lists: DataFrame, p: TopKParams) -> DataFrame:
    fan_in, k = p.fan_in, p.k

    def merge(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        ids = np.frombuffer(rows[0]["ids"], np.int64)
        scores, found = (np.concatenate([np.frombuffer(r[c], np.int64).reshape(len(ids), -1) for r in rows], axis=1) for c in ("scores", "found"))
        best, found = best_of(scores, found, k)
        return pa.Table.from_batches([_list(rows[0]["query_block"], rows[0]["lane"] // fan_in, ids, found, best)])

    return lists.groupBy("query_block", F.floor(F.col("lane") / fan_in).alias("group")).applyInArrow(merge, _LIST)


def top_k(vectors: DataFrame, is_query: Column, p: TopKParams = TopKParams()) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query row's k best other rows; `is_query` is a condition on the rows."""
    blocks = _blocks(vectors, is_query, p)
    queries = _query_blocks(blocks, p)
    lanes = max(1, min(-(-blocks.count() // p.lane), p.lanes))
    lists = _tiles(queries, blocks, lanes, p)
    while True:                                  # at least once: a query block's lists of a lane may come in parts
        lists = stored(_merged(lists, p), "search-lists")
        lanes = -(-lanes // p.fan_in)
        if lanes == 1:
            break

    def rows(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                found, scores = (np.frombuffer(r[c], np.int64).reshape(len(ids), -1) for c in ("found", "scores"))
                rank = np.broadcast_to(np.arange(1, found.shape[1] + 1, dtype=np.int32), found.shape)
                full = scores != _NONE
                query = np.broadcast_to(ids[:, None], found.shape)
                yield pa.RecordBatch.from_arrays([pa.array(x[full]) for x in (query, rank, found, scores)], ["query_id", "rank", "vec_id", "score"])

    return lists.mapInArrow(rows, "query_id long, rank int, vec_id long, score long")
