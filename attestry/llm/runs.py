"""Periodic runs of words: maximal repetitions found by suffix-tree LCE queries from Lyndon roots.

Each run has an occurrence of its Lyndon root that is the longest Lyndon word
starting at some position, in the order of the letters or in the reverse order
(Bannai et al. 2017).  Positions of the next smaller and the next greater suffix
give these words; Ukkonen suffix trees of the words and of their reversal, with
constant-time lowest common ancestors by Euler tour, extend each of them in both
directions.  What reaches twice its period is a run.

Only words that can lie in a run enter the trees: a run of `least` words or
more repeats a stretch of least / 2 words at the distance of its period, and all
of its words lie in such stretches.  Other words become one separator, so the
result is the same (`tests/llm/test_runs.py` holds it against trees of whole
texts and against brute force).

Cases: null and empty texts have no words and no run; very long texts are taken
whole, in memory in proportion to their repeated words; rows that repeat an id
are taken row by row; extra columns are ignored; an empty table gives an empty
table; a null id has the check sum of the empty text.
"""

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from attestry.llm.tokens import parts


@dataclass(frozen=True)
class RunParams:
    least: int = 12             # words of a run, at least; also twice its period
    covered: bool = True        # leave words that are in no repeated stretch out of the trees


class SuffixTree:
    """Ukkonen's tree of a list of letters 1 ..; a letter 0 is added at the end."""

    def __init__(self, letters: list[int]):
        s = [*letters, 0]
        n, width = len(s), max(s) + 1
        start, end, link, child = [0], [0], [0], {}
        node = edge = length = rest = 0
        for i, c in enumerate(s):
            rest += 1
            made = 0                                                # inner node that waits for its suffix link
            while rest:
                if not length:
                    edge = i
                key = node * width + s[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(start)
                    start.append(i); end.append(n); link.append(0)
                    if made:
                        link[made] = node
                        made = 0
                else:
                    a = start[below]
                    size = end[below] - a
                    if length >= size:                              # a leaf ends at n, past what is read
                        node = below
                        edge += size
                        length -= size
                        continue
                    if s[a + length] == c:
                        length += 1
                        if made:
                            link[made] = node
                        break
                    split = len(start)
                    start.append(a); end.append(a + length); link.append(0)
                    start.append(i); end.append(n); link.append(0)
                    child[key] = split
                    start[below] = a + length
                    child[split * width + s[a + length]] = below
                    child[split * width + c] = split + 1
                    if made:
                        link[made] = split
                    made = split
                rest -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - rest + 1
        self.n, self.width = n, width
        self._tour(start, end, child)

    def _tour(self, start: list[int], end: list[int], child: dict) -> None:
        """Euler tour of string depths, each suffix's place in it, and the suffixes' ranks."""
        keys = np.fromiter(child.keys(), np.int64, len(child))
        below = np.fromiter(child.values(), np.int64, len(child))
        order = np.argsort(keys)                                    # by parent, then by letter
        first = np.searchsorted(keys[order], np.arange(len(start) + 1, dtype=np.int64) * self.width).tolist()
        below = below[order].tolist()
        depth, tour, n = [0] * len(start), [], self.n
        place, rank, seen = [0] * n, [0] * n, 0
        path, at = [0], first[:-1]
        while path:
            v = path[-1]
            d = depth[v]
            tour.append(d)
            if at[v] < first[v + 1]:
                u = below[at[v]]
                at[v] += 1
                if first[u] == first[u + 1]:                        # a leaf: its depth tells the suffix
                    suffix = n - d - (n - start[u])
                    place[suffix], rank[suffix] = len(tour), seen
                    tour.append(n - suffix)
                    seen += 1
                else:
                    depth[u] = d + end[u] - start[u]
                    path.append(u)
            else:
                path.pop()
        self.place, self.rank = np.array(place), rank
        self._table(np.array(tour, np.int32))

    def _table(self, tour: np.ndarray, block: int = 8) -> None:
        """Minima from and up to each place inside blocks, and a sparse table over blocks."""
        full = np.full(-(-len(tour) // block) * block, np.iinfo(np.int32).max, np.int32)
        full[:len(tour)] = tour
        square = full.reshape(-1, block)
        self.block, self.tour = block, full
        self.upto = np.minimum.accumulate(square, axis=1).ravel()
        self.since = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [square.min(axis=1)]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last, np.concatenate((last[step:], np.full(step, np.iinfo(np.int32).max, np.int32)))))

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the longest common prefixes of suffixes i and j (i <> j): the depth of the leaves' lowest common ancestor."""
        a, b = self.place[i], self.place[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        x, y = a // self.block, b // self.block
        low = np.minimum(self.since[a], self.upto[b])
        gap = y - x - 1
        for k, level in enumerate(self.levels):
            here = np.nonzero((gap >= 1 << k) & (gap < 2 << k))[0]
            if len(here):
                low[here] = np.minimum(low[here], np.minimum(level[x[here] + 1], level[y[here] - (1 << k)]))
        same = np.nonzero(gap < 0)[0]
        if len(same):
            near = np.minimum(a[same][:, None] + np.arange(self.block), b[same][:, None])
            low[same] = self.tour[near].min(axis=1)
        return low


def _next_smaller(rank: list[int]) -> list[int]:
    """For each place the next one with a smaller value (the number of places, if there is none)."""
    out, stack = [len(rank)] * len(rank), []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return out


def lyndon_runs(letters: list[int], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end exclusive, smallest period) of all runs of at least max(least, 2 * period) letters, by start, then period."""
    m = len(letters)
    ahead, back = SuffixTree(letters), SuffixTree(letters[::-1])
    below = np.array(_next_smaller(ahead.rank)[:m])
    above = np.minimum(np.array(_next_smaller([-r for r in ahead.rank])[:m]), m)
    i = np.concatenate([np.arange(m)] * 2)
    period = np.concatenate((below, above)) - i
    keep = 2 * period <= m
    i, period = i[keep], period[keep]
    if not len(i):
        return i, i, i
    end = i + period + ahead.lce(i, i + period)
    start = i - back.lce(m - i, m - i - period)
    keep = end - start >= np.maximum(least, 2 * period)
    start, end, period = start[keep], end[keep], period[keep]
    order = np.lexsort((period, end, start))                        # of the same stretch, the smallest period
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _repeated(ids: np.ndarray, k: int) -> np.ndarray:
    """Marks the words in stretches of k that occur more than once (a clash of hashes may mark a few more)."""
    n = len(ids) - k + 1
    mark = np.zeros(len(ids), bool)
    if n < 2:
        return mark
    x, grams = ids.astype(np.uint64) + np.uint64(1), np.zeros(n, np.uint64)
    for t in range(k):
        grams = (grams ^ x[t:t + n]) * np.uint64(0x9E3779B97F4A7C15)
        grams ^= grams >> np.uint64(29)
    ordered = np.sort(grams)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(twice):
        step = np.zeros(len(ids) + 1, np.int64)
        at = np.nonzero(np.isin(grams, twice))[0]
        np.add.at(step, at, 1)
        np.add.at(step, at + k, -1)
        mark = np.cumsum(step)[:-1] > 0
    return mark


def word_runs(words: list[bytes], p: RunParams = RunParams()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of a list of words: (start, end exclusive, smallest period)."""
    n, none = len(words), (np.zeros(0, np.int64),) * 3
    if n < p.least:
        return none
    numbers = dict(zip(words, range(n)))
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, n)
    inside = _repeated(ids, p.least // 2) if p.covered and p.least > 1 else np.ones(n, bool)
    if not inside.any():
        return none
    at = np.nonzero(inside)[0]
    gap = np.nonzero(at[1:] - at[:-1] > 1)[0] + 1                   # where a stretch begins after another
    _, letters = np.unique(ids[at], return_inverse=True)
    top = int(letters.max()) + 2
    places = np.insert(at, gap, -1)
    start, end, period = lyndon_runs(np.insert(letters + 1, gap, top + np.arange(len(gap))).tolist(), p.least)
    return places[start], places[end - 1] + 1, period


def _planted(words: list[bytes], doc_id: str) -> list[bytes]:
    """The words, made periodic from some place on for a tenth of the ids."""
    h, n = zlib.crc32(doc_id.encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    q = 1 + (n - a) // (3 + g % 8)
    unit = words[a:a + q]
    return words[:a] + (unit * (-(-(n - a) // q)))[:n - a]


def _hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def summary(words: list[bytes], p: RunParams) -> tuple:
    """Number of runs, the greatest one's start, length, period and thousandths of exponent, digests of all runs and of the words kept."""
    start, end, period = word_runs(words, p)
    if not len(start):
        return 0, None, None, None, None, _hex(b""), _hex(b" ".join(words))
    length = end - start
    best = np.lexsort((period, start, -length))[0]
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, start + period, 1)
    np.add.at(step, end, -1)
    kept = np.nonzero(np.cumsum(step)[:-1] == 0)[0].tolist()
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in zip(start.tolist(), length.tolist(), period.tolist()))
    s, n, q = int(start[best]), int(length[best]), int(period[best])
    return len(start), s, n, q, 1000 * n // q, _hex(listed.encode()), _hex(b" ".join([words[i] for i in kept]))


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def find(docs: DataFrame, p: RunParams = RunParams(), plant: bool = False) -> DataFrame:
    """One row per document: doc_id and COLUMNS; with `plant`, a tenth of the ids are made periodic first."""

    def run(batches):
        for batch in parts(batches):
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
                rows.append(summary(_planted(words, "" if i is None else str(i)) if plant else words, p))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], ["doc_id", *COLUMNS])

    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} {'string' if c.endswith('256') else 'long'}" for c in COLUMNS)
    return docs.select("doc_id", "text").mapInArrow(run, kind)


def collapsed(text: str | None, p: RunParams = RunParams()) -> str:
    """The text's words without what repeats inside runs, joined by single spaces."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    start, end, period = word_runs(words, p)
    keep = np.ones(len(words), bool)
    for s, e, q in zip(start.tolist(), end.tolist(), period.tolist()):
        keep[s + q:e] = False
    return b" ".join([words[i] for i in np.nonzero(keep)[0].tolist()]).decode("utf-8", "surrogatepass")
