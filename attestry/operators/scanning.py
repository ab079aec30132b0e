"""Texts scanned for the keys of a vocabulary, exactly or nearly.

The vocabulary is dealt into chunks of at most about `chunk` keys; a chunk
becomes one automaton or index, and texts stream past it in Arrow batches.
Nothing is exploded into grams: rows out are the hits.  Up to `SENT` chunks go to
the workers with the tasks, so that texts are not shuffled at all; a larger
vocabulary is dealt over groups of its own, and texts visit each chunk once.
"""

import math
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions import similarity as sim

#: keys in a chunk, chunks that are sent with the tasks, and texts that meet a chunk in one group beyond that
CHUNK, SENT, ROWS = 20_000, 8, 20_000

Finder = Callable[[list[str]], Callable[[list[str]], Iterable[tuple[int, str, float]]]]


def scan(df: DataFrame, keep: list[str], text: str, keys: DataFrame, key: str, finder: Finder, chunk: int = CHUNK, sent: int = SENT,
         name: str | None = None) -> DataFrame:
    """(keep, key, score): what `finder(keys)(texts)` finds in the rows' texts (row, key, score), a row per hit.  With `name`, the
    finder gets (key, name) pairs."""
    fields = ["__key", "__name"] if name else ["__key"]
    k = keys.select(F.col(key).alias("__key"), *([F.col(name).alias("__name")] if name else [])).where(F.length("__key") > 0).distinct()
    n = max(1, math.ceil(k.count() / chunk))
    k = k.withColumn("__chunk", F.pmod(F.xxhash64("__key"), F.lit(n)).cast("int"))
    texts = df.where(F.length(text) > 0).select(*keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", key string, score double"
    names = [*keep, "key", "score"]

    def hits(table, find):
        found = list(find(table.column("__text").to_pylist()))
        at = pa.array([i for i, _, _ in found], pa.int64())
        return [*[table.column(c).take(at) for c in keep], pa.array([x for _, x, _ in found], pa.string()), pa.array([s for _, _, s in found], pa.float64())]

    if n <= sent:
        def run(own: list[str]):
            def rows(batches):
                find = finder(own)
                for batch in batches:
                    for at in range(0, batch.num_rows, 1000):
                        yield pa.RecordBatch.from_arrays(hits(batch.slice(at, 1000), find), names)

            return texts.mapInArrow(rows, schema)

        out = None
        for c in range(n):      # at most `sent` chunks, each of a bounded number of keys
            part = run(sorted(tuple(r) if name else r[0] for r in k.where(F.col("__chunk") == c).select(*fields).collect()))
            out = part if out is None else out.union(part)
        return out

    salts = max(1, math.ceil(texts.count() / ROWS))
    left = texts.withColumn("__salt", F.pmod(F.xxhash64("__text", F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
    left = left.withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    right = k.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def both(a, b):
        own = [b.column(c).to_pylist() for c in fields]
        return pa.Table.from_arrays(hits(a.combine_chunks(), finder(list(zip(*own)) if name else own[0])), names=names)

    return left.groupBy("__salt", "__chunk").cogroup(right.groupBy("__salt", "__chunk")).applyInArrow(both, schema)


def contained(keys: list[str]):
    """Keys that occur anywhere in a text, each once: one pass of an Aho-Corasick automaton."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for key in keys:
        automaton.add_word(key, key)
    automaton.make_automaton()

    def find(texts):
        if keys:
            for i, t in enumerate(texts):
                for key in {x for _, x in automaton.iter(t)}:
                    yield i, key, 100.0

    return find


class NearFinder:
    """Keys whose partial ratio with a text is at least `least`: the best 200 * LCS / (length + window) over windows of the
    text that are as long as the key, or shorter at its ends.

    Inside a text a window is as long as its key, so as many letters are inserted as deleted, each at most d = (1 - least) * length.
    Of 2 * d + 1 pieces of the key one occurs unchanged, and all that agrees lies within d diagonals of it.  Pieces of all keys are
    looked up at once; a hit stays if enough letter pairs of its key occur on those diagonals: a deleted letter spoils two pairs,
    an inserted one a single pair.  Only windows around the hits that stay are compared, a bit for each character of the key.
    Windows at the ends of a text, which may be shorter, are compared if the text begins or ends with enough of the key's q-grams: a
    deleted letter spoils q of them and an inserted one q - 1, and they lie within as many diagonals of the end.
    """

    def __init__(self, keys: list[str], least: float):
        self.keys, self.least = [k for k in keys if k], least
        self.length = np.array([len(k) for k in self.keys], np.int64)
        self.longest = int(self.length.max(initial=0))
        self.edits = np.floor(2 * (1 - least / 100) * self.length + 1e-9).astype(np.int64)
        self.drift = np.floor((1 - least / 100) * self.length + 1e-9).astype(np.int64)
        share = least / 100
        self.shortest = np.ceil(share * self.length / (2 - share) - 1e-9).astype(np.int64)      # a shorter window cannot reach the ratio
        self.q = np.where(self.length - 2 - 3 * self.edits >= 3, 3, 2)
        self.needed = self.length - self.q + 1 - self.q * self.edits
        self.deleted, self.inserted, self.kept = self._end_edits()
        self.index = {q: self._postings(np.nonzero((self.q == q) & (self.needed >= 1))[0].tolist(), q) for q in (2, 3)}
        self.every = np.nonzero(self.needed < 1)[0]              # no gram must survive: all windows are compared
        self.masks = [self._mask(k) if len(k) < 64 else None for k in self.keys]
        points = sorted(set(map(ord, "".join(self.keys))))
        self.base = len(points) + 1                              # 0 stands for every letter that no key has
        self.letter = np.zeros(0x110000, np.uint8 if self.base < 255 else np.uint32)
        self.letter[points] = np.arange(1, self.base)
        self.pieces = self._pieces(np.nonzero(self.needed >= 1)[0].tolist())
        self.padded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _end_edits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Most letters deleted and inserted, and least grams left, in the shorter windows of each key."""
        deleted, inserted = np.zeros(len(self.keys), np.int64), np.zeros(len(self.keys), np.int64)
        kept = self.length - self.q + 1
        for cut in range(1, int((self.length - self.shortest).max(initial=0)) + 1):
            ok = cut <= self.length - self.shortest
            edits = np.floor((1 - self.least / 100) * (2 * self.length - cut) + 1e-9).astype(np.int64)
            gone = np.where(ok, (edits + cut) // 2, 0)           # the deleted outnumber the inserted by the cut
            new = np.where(ok, np.maximum(gone - cut, 0), 0)
            deleted, inserted = np.maximum(deleted, gone), np.maximum(inserted, new)
            kept = np.minimum(kept, self.length - self.q + 1 - self.q * gone - (self.q - 1) * new)
        return deleted, inserted, kept

    def _codes(self, text: str) -> np.ndarray:
        return self.letter[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def _numbers(self, code: np.ndarray, q: int) -> np.ndarray:
        """One number for each q letters in a row."""
        n = max(len(code) - q + 1, 0)
        out = np.zeros(n, np.int64)
        for j in range(q):
            out = out * self.base + code[j:j + n]
        return out

    def _pieces(self, own: list[int]) -> dict[int, tuple[np.ndarray, ...]]:
        """For each length the numbers of pieces, and for each number its (key, offset) pairs in one array; a long piece is known by its
        first four letters.  A gram must survive, so that no piece is shorter than two."""
        rows: dict[int, list[tuple[int, int, int]]] = {}
        for k in own:
            m, n = len(self.keys[k]), 2 * int(self.drift[k]) + 1
            code = self._codes(self.keys[k])
            for j in range(n):
                at, q = j * m // n, min((j + 1) * m // n - j * m // n, 4)
                rows.setdefault(q, []).append((int(self._numbers(code[at:at + q], q)[0]), k, at))
        out = {}
        for q, found in rows.items():
            table = np.array(found, np.int64)
            table = table[np.argsort(table[:, 0], kind="stable")]
            numbers, first = np.unique(table[:, 0], return_index=True)
            out[q] = numbers, np.append(first, len(table)), table[:, 1], table[:, 2]
        return out

    def _postings(self, own: list[int], q: int):
        """Gram numbers, and for each its (key, offset) pairs in one array."""
        grams: dict[str, int] = {}
        rows = []
        for k in own:
            key = self.keys[k]
            rows += [(grams.setdefault(key[o:o + q], len(grams)), k, o) for o in range(len(key) - q + 1)]
        table = np.array(rows or np.zeros((0, 3)), np.int64)
        table = table[np.argsort(table[:, 0], kind="stable")]
        return grams, np.searchsorted(table[:, 0], np.arange(len(grams) + 1)), table[:, 1], table[:, 2]

    @staticmethod
    def _mask(key: str) -> dict[str, int]:
        mask: dict[str, int] = {}
        for i, c in enumerate(key):
            mask[c] = mask.get(c, 0) | 1 << i
        return mask

    def _inside(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, start) of whole windows around a surviving piece."""
        keys, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for q, (numbers, first, owner, offset) in self.pieces.items():
            own = self._numbers(code, q)
            place = np.minimum(np.searchsorted(numbers, own), len(numbers) - 1)
            at = np.nonzero(numbers[place] == own)[0]
            place = place[at]
            n = first[place + 1] - first[place]
            where = np.repeat(first[place] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            keys.append(owner[where])
            starts.append(np.repeat(at, n) - offset[where])
        k, diagonal = np.concatenate(keys), np.concatenate(starts)
        ok = (diagonal + self.drift[k] >= 0) & (diagonal - self.drift[k] + self.length[k] <= len(code))
        k, diagonal = k[ok], diagonal[ok]
        stay = np.zeros(len(k), bool)
        for d in np.unique(self.drift[k]).tolist():
            group = np.nonzero(self.drift[k] == d)[0]
            for at in range(0, len(group), 32768):
                part = group[at:at + 32768]
                stay[part] = self._agrees(code, k[part], diagonal[part], d)
        k, diagonal = k[stay], diagonal[stay]
        k, start = self._starts(k, diagonal - self.drift[k], 2 * self.drift[k] + 1, len(code))
        ok = (start >= 0) & (start + self.length[k] <= len(code))
        return k[ok], start[ok]

    def _agrees(self, code: np.ndarray, key: np.ndarray, diagonal: np.ndarray, d: int) -> np.ndarray:
        """Whether enough letter pairs of the keys lie within d diagonals; all keys have drift d."""
        if d not in self.padded:
            own = np.nonzero(self.drift == d)[0]
            rows = np.full((len(own), int(self.length[own].max())), self.base, self.letter.dtype)       # met by no letter
            for i, k in enumerate(own.tolist()):
                rows[i, :len(self.keys[k])] = self._codes(self.keys[k])
            self.padded[d] = own, rows
        own, rows = self.padded[d]
        name, m = rows[np.searchsorted(own, key)], rows.shape[1]
        around = np.concatenate((np.zeros(2 * d, code.dtype), code, np.zeros(m + 2 * d, code.dtype)))
        text = np.lib.stride_tricks.sliding_window_view(around, m + 2 * d)[diagonal + d]
        pairs = np.zeros((len(key), m - 1), bool)
        for shift in range(2 * d + 1):
            same = text[:, shift:shift + m] == name
            pairs |= same[:, 1:] & same[:, :-1]
        return np.count_nonzero(pairs, axis=1) >= self.length[key] - 1 - 3 * d

    def _ends(self, text: str, q: int) -> tuple[np.ndarray, np.ndarray]:
        """(key, start) of shorter windows at both ends, of keys that have enough grams there."""
        grams, first, keys, offsets = self.index[q]
        size, places = len(text), len(text) - q + 1
        if not grams or places < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = [*range(min(self.longest, places)), *range(max(size - self.longest, min(self.longest, places), 0), places)]
        code = np.array([grams.get(text[i:i + q], -1) for i in at], np.int64)
        at = np.array(at, np.int64)[code >= 0]
        code = code[code >= 0]
        n = first[code + 1] - first[code]
        place = np.repeat(first[code] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        k, p = keys[place], np.repeat(at, n)
        front = p - offsets[place]                               # diagonals from the first letters, and from the last ones
        back = size - self.length[k] - front
        ends = [np.nonzero(np.bincount(k[near], minlength=len(self.keys)) >= np.maximum(self.kept, 1))[0]
                for near in ((x >= -self.deleted[k]) & (x <= self.inserted[k]) for x in (front, back))]
        cut = self.length - self.shortest
        before = self._starts(ends[0], -cut[ends[0]], cut[ends[0]], size)
        after = self._starts(ends[1], size - self.length[ends[1]] + 1, cut[ends[1]], size)
        return tuple(map(np.concatenate, zip(before, after)))

    def _starts(self, k: np.ndarray, low: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        key = np.repeat(k, n)
        start = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
        ok = (start > -self.length[key]) & (start < size)
        pairs = np.unique(key[ok] * (2 * size + int(self.length.max(initial=0)) + 2) + start[ok] + int(self.length.max(initial=0)))
        return pairs // (2 * size + int(self.length.max(initial=0)) + 2), pairs % (2 * size + int(self.length.max(initial=0)) + 2) - int(self.length.max(initial=0))

    def _windows(self, text: str, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, start) of all windows to compare."""
        fits = [self._inside(code), self._ends(text, 2), self._ends(text, 3)]
        if len(self.every):
            fits.append(self._starts(self.every, 1 - self.length[self.every], len(text) + self.length[self.every] - 1, len(text)))
        k, s = map(np.concatenate, zip(*fits))
        ok = self.length[k] <= len(text)
        return k[ok], s[ok]

    def __call__(self, texts: list[str], letters: int = 1 << 20, lanes: int = 65536) -> Iterable[tuple[int, str, float]]:
        """(text number, key, score); the windows of many texts, up to about `letters` letters, are compared together."""
        own, at = [], 0
        for i, text in enumerate(texts):
            own.append((i, text, self._codes(text)))
            at += len(text)
            if at >= letters or i == len(texts) - 1:
                yield from self._found(own, lanes)
                own, at = [], 0

    def _found(self, texts: list[tuple[int, str, np.ndarray]], lanes: int) -> Iterable[tuple[int, str, float]]:
        gap = np.zeros(self.longest, self.letter.dtype)          # windows that stick out meet no letter
        base = np.cumsum([self.longest] + [len(c) + self.longest for _, _, c in texts])
        code = np.concatenate([gap, *[x for _, _, c in texts for x in (c, gap)]])
        best: dict[tuple[int, int], float] = {}
        parts, waiting = [], 0
        for j, (_, text, own) in enumerate(texts):
            k, s = self._windows(text, own)
            if len(k):
                parts.append((np.full(len(k), j), k, s))
                waiting += len(k)
            if parts and (waiting >= lanes or j == len(texts) - 1):
                which, k, s = map(np.concatenate, zip(*parts))
                for at in range(0, len(k), lanes):
                    self._compare(texts, base, code, which[at:at + lanes], k[at:at + lanes], s[at:at + lanes], best)
                parts, waiting = [], 0
        if parts:
            self._compare(texts, base, code, *map(np.concatenate, zip(*parts)), best)
        for (j, k), v in sorted(best.items()):
            if v >= self.least - 1e-9:
                yield texts[j][0], self.keys[k], v

    def _compare(self, texts: list, base: np.ndarray, code: np.ndarray, which: np.ndarray, key: np.ndarray, start: np.ndarray,
                 best: dict[tuple[int, int], float]) -> None:
        """Raise `best` to the ratios of keys and windows; LCS rows are bit vectors, one lane for each window."""
        own, local = np.unique(key, return_inverse=True)
        table = np.zeros((len(own), self.base), np.uint64)
        for i, k in enumerate(own.tolist()):
            for c, bits in (self.masks[k] or {}).items():
                table[i, self.letter[ord(c)]] = bits
        m, size = self.length[key], np.array([len(c) for _, _, c in texts], np.int64)[which]
        full = (np.uint64(1) << np.minimum(m, 63).astype(np.uint64)) - np.uint64(1)
        state, first, row = full.copy(), base[which] + start, local * self.base
        table = table.ravel()
        with np.errstate(over="ignore"):
            for j in range(int(np.where(m < 64, m, 0).max(initial=0))):
                hit = state & np.where(j < m, table[row + code[first + j]], np.uint64(0))
                state = (state + hit) | (state - hit)
        common = np.bitwise_count(~state & full).astype(np.float64)
        ratio = 200.0 * common / (m + np.minimum(start + m, size) - np.maximum(start, 0))
        pair, group = np.unique(which * len(self.keys) + key, return_inverse=True)
        top = np.zeros(len(pair))
        np.maximum.at(top, group, ratio)
        for p, v in zip(pair.tolist(), top.tolist()):
            j, k = divmod(p, len(self.keys))
            if self.masks[k] is not None:
                best[j, k] = max(best.get((j, k), 0.0), v)
            elif (j, k) not in best:
                best[j, k] = sim.partial(self.keys[k], texts[j][1])


def near(least: float) -> Finder:
    """Keys that slide along the texts."""

    def finder(keys):
        return NearFinder(keys, least)

    return finder


def near_within(least: float) -> Finder:
    """Texts that slide along the keys: for texts that are no longer than a key."""

    def finder(keys):
        def find(texts):
            rows: dict[str, list[int]] = {}
            for i, t in enumerate(texts):
                rows.setdefault(t, []).append(i)
            for k, t, score in NearFinder(list(rows), least)(keys):
                for i in rows[t]:
                    yield i, keys[k], score

        return find

    return finder


def near_mentions(df: DataFrame, keep: list[str], text: str, keys: DataFrame, key: str, least: float, chunk: int = CHUNK, sent: int = SENT) -> DataFrame:
    """(keep, key, score): keys whose partial ratio with the row's text is at least `least`; the shorter of both slides along the longer."""
    longest = keys.agg(F.max(F.length(key))).first()[0] or 0
    short = df.where(F.length(text) <= longest)
    found = scan(df, keep, text, keys, key, near(least), chunk, sent).union(scan(short, keep, text, keys, key, near_within(least), chunk, sent))
    return found.groupBy(*keep, "key").agg(F.max("score").alias("score"))
