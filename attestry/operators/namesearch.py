"""Top-k search of names and paths by weighted similarity, without scoring every pair.

Names are taken in the order of an upper bound of their similarity and the
search stops when the k-th score beats the next bound.  The first bound comes
from letter counts (no common subsequence is longer than the letters two names
share), from lengths, and from an inverted index of words, which tells the
length of the words two names share and so what the token ratios can reach.  A
second, sharper one replaces the letter counts by the true common subsequences,
of names as they are and with their words sorted, found for many names at a time
with a bit for each letter of the query.  Paths are bounded on two levels, the
last segments and the whole paths under them.
"""

from collections.abc import Callable

import numpy as np

from attestry.functions import similarity as sim

_COLUMNS = 64       # letters are counted in so many columns; letters that share one only loosen the bound


def _words_length(words: set[str]) -> int:
    return sum(map(len, words)) + max(len(words) - 1, 0)


def window(common: np.ndarray, short: np.ndarray) -> np.ndarray:
    """What a partial ratio cannot exceed if no window shares more than `common` letters with the shorter text."""
    return np.minimum(100.0, 200.0 * common / np.maximum(short + np.minimum(common, short), 1))


def bounded_top(bound: np.ndarray, sharper: Callable[[np.ndarray], np.ndarray], score: Callable[[int], float], k: int) -> tuple[list[tuple[int, float]], int]:
    """(number, score) of the k best, ties by number, and how many were scored: by falling bound, in steps that `sharper` bounds again."""
    order = np.lexsort((np.arange(len(bound)), -bound))
    best: list[tuple[float, int]] = []
    begin, step, scored = 0, 64, 0
    while begin < len(order) and not (len(best) == k and bound[order[begin]] < -best[-1][0] - 1e-9):
        some = order[begin:begin + step]
        sharp = np.minimum(sharper(some), bound[some])
        for i in np.lexsort((some, -sharp)).tolist():
            at = int(some[i])
            if len(best) == k and sharp[i] < -best[-1][0] - 1e-9:
                break
            if len(best) == k and sharp[i] <= -best[-1][0] and at > best[-1][1]:
                continue                                    # could only tie with a name that comes before it
            scored += 1
            best.append((-score(at), at))
            best.sort()
            del best[k:]
        begin, step = begin + step, 2 * step
    return [(at, -s) for s, at in best], scored


class NameIndex:
    """Names of a vocabulary chunk, in the order that breaks ties; names have no blanks at the ends and single ones inside."""

    def __init__(self, keys: list[str]):
        self.keys, self.scored = keys, 0
        n = len(keys)
        self.length = np.array([len(k) for k in keys], np.int64)
        self.letters = np.zeros((_COLUMNS, n), np.int16)
        self.unique = np.zeros(n, np.int64)                 # length of the distinct words side by side
        self.words = np.zeros(n, np.int64)                  # number of distinct words
        self.postings: dict[str, list[int]] = {}
        self.sorted_length = np.array([len(" ".join(k.split())) for k in keys], np.int64)
        self.plain, self.ordered = self._matrix(keys), self._matrix([" ".join(sorted(k.split())) for k in keys])
        for i, k in enumerate(keys):
            self.letters[:, i] = self._count(k)
            own = set(k.split())
            self.unique[i], self.words[i] = _words_length(own), len(own)
            for w in own:
                self.postings.setdefault(w, []).append(i)

    @staticmethod
    def _count(text: str) -> np.ndarray:
        return np.bincount(np.fromiter(map(ord, text), np.int64, len(text)) % _COLUMNS, minlength=_COLUMNS)

    @staticmethod
    def _matrix(keys: list[str]) -> np.ndarray:
        """Letters of names, a row per place; -1 past the end."""
        out = np.full((max(map(len, keys), default=0), len(keys)), -1, np.int32)
        for i, k in enumerate(keys):
            out[:len(k), i] = np.fromiter(map(ord, k), np.int32, len(k))
        return out

    @staticmethod
    def _common(query: str, names: np.ndarray) -> np.ndarray:
        """Lengths of longest common subsequences with the columns of `names`: rows of the table as bits, carries passed between words."""
        if not query:
            return np.zeros(names.shape[1], np.int64)
        n = max(1, -(-len(query) // 64))
        letters, place = np.unique(np.fromiter(map(ord, query), np.int32, len(query)), return_inverse=True)
        masks = np.zeros((n, len(letters) + 1), np.uint64)
        spot = np.arange(len(query))
        np.bitwise_or.at(masks, (spot // 64, place), np.uint64(1) << (spot % 64).astype(np.uint64))
        state = np.full((n, names.shape[1]), np.uint64(0xFFFFFFFFFFFFFFFF))
        with np.errstate(over="ignore"):
            for row in names:
                at = np.minimum(np.searchsorted(letters, row), len(letters) - 1)
                at = np.where(letters[at] == row, at, len(letters))
                carry = np.zeros(names.shape[1], np.uint64)
                for w in range(n):
                    old = state[w]
                    hit = old & masks[w, at]
                    added = old + hit
                    total = added + carry
                    carry = ((added < old) | (total < added)).astype(np.uint64)
                    state[w] = total | (old & ~hit)
        last = np.uint64(0xFFFFFFFFFFFFFFFF) >> np.uint64(n * 64 - len(query))
        state[-1] |= ~last
        return np.bitwise_count(~state).sum(axis=0, dtype=np.int64)

    def bounds(self, query: str, at: np.ndarray | None = None) -> np.ndarray:
        """What the weighted similarity of the query with each name cannot exceed; of the names `at`, the sharper bound."""
        if at is not None:
            return self._sharper(query, at)
        own, own_words = self._count(query), set(query.split())
        used = np.nonzero(own)[0]
        common = np.minimum(self.letters[used], own[used][:, None].astype(np.int16)).sum(axis=0, dtype=np.int64)
        shared, sharing = np.zeros(len(self.keys), np.int64), np.zeros(len(self.keys), np.int64)
        for w in own_words:
            at = self.postings.get(w)
            if at:
                shared[at] += len(w) + 1
                sharing[at] += 1
        both = np.maximum(shared - 1, 0)                    # length of the shared words side by side
        n, unique = len(query), _words_length(own_words)
        whole = 200.0 * common / np.maximum(self.length + n, 1)
        short, long = np.minimum(self.length, n), np.maximum(self.length, n)
        spread = long / np.maximum(short, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            token = np.where(self.unique + unique < self.length + n, 200.0 * common / np.maximum(self.unique + unique, 1), 0.0)     # names that repeat words
            token = np.where(sharing > 0, np.maximum.reduce([token, 200.0 * common / np.maximum(self.unique + unique, 1),
                                                             200.0 * both / (both + unique), 200.0 * both / (both + self.unique)]), token)
            token = np.where((sharing > 0) & ((sharing == len(own_words)) | (sharing == self.words)), 100.0, token)
            least = np.minimum(short, np.minimum(self.unique, unique))
            partial = np.minimum(100.0, 200.0 * common / np.maximum(least + np.minimum(common, least), 1))
        scale = np.where(spread < 8, 0.9, 0.6)
        repeats = (self.unique < self.length) | (unique < n)
        self._parts = short, spread < 1.5, scale, np.where(sharing > 0, 100.0, np.where(repeats, partial, 0.0)), token
        rest = np.where(spread < 1.5, 0.95 * np.minimum(token, 100.0), scale * np.maximum(partial, 0.95 * np.where(sharing > 0, 100.0, partial)))
        return np.minimum(np.maximum(whole, rest), 100.0)

    def _sharper(self, query: str, at: np.ndarray) -> np.ndarray:
        """Uses what `bounds(query)` left: what true common subsequences do not replace, that is words shared or repeated."""
        short, near, scale, tokens, token = (x[at] for x in self._parts)
        by_word = " ".join(sorted(query.split()))
        total, ordered_total = np.maximum(self.length[at] + len(query), 1), np.maximum(self.sorted_length[at] + len(by_word), 1)
        whole, ordered = self._common(query, self.plain[:, at]), self._common(by_word, self.ordered[:, at]) if by_word else np.zeros(len(at), np.int64)
        self.whole = window(whole, short)
        close = 0.95 * np.minimum(np.maximum(token, 200.0 * ordered / ordered_total), 100.0)
        far = scale * np.maximum(self.whole, 0.95 * np.maximum(tokens, window(ordered, np.minimum(self.sorted_length[at], len(by_word)))))
        return np.minimum(np.maximum(200.0 * whole / total, np.where(near, close, far)), 100.0)

    def top(self, query: str, k: int) -> list[tuple[int, float]]:
        """(name number, similarity) of the k best, ties by number."""
        best, scored = bounded_top(self.bounds(query), lambda at: self.bounds(query, at), lambda i: sim.composite(query, self.keys[i]), k)
        self.scored += scored
        return best


class PathIndex:
    """Paths with `>` between levels, sorted.  Paths hang under their last segments: a segment is bounded and scored once for all
    of its paths, and a path only adds the bound of the whole."""

    def __init__(self, paths: list[str]):
        self.paths, self.scored = paths, 0
        ends = [p.rsplit(">", 1)[-1] for p in paths]
        self.leaves = sorted(set(ends))
        number = {x: i for i, x in enumerate(self.leaves)}
        self.leaf_of = np.array([number[x] for x in ends], np.int64)
        self.whole, self.leaf = NameIndex(paths), NameIndex(self.leaves)

    def _search(self, query: str):
        """Bound of each path, the function that sharpens it for some, and the score of one."""
        end = query.rsplit(">", 1)[-1]
        low = self.leaf.bounds(end)
        everything = np.arange(len(self.leaves))
        low = np.minimum(low, self.leaf.bounds(end, everything)) if len(everything) else low
        low = np.maximum(low, self.leaf.whole)              # the last segment sliding along the other
        whole, seen = self.whole.bounds(query), {}

        def score(i: int) -> float:
            leaf = int(self.leaf_of[i])
            if leaf not in seen:
                other = self.leaves[leaf]
                seen[leaf] = max(sim.composite(end, other), sim.partial(end, other))
            return max(seen[leaf], sim.composite(query, self.paths[i]))

        return np.maximum(whole, low[self.leaf_of]), lambda at: np.maximum(self.whole.bounds(query, at), low[self.leaf_of[at]]), score

    def top(self, query: str, k: int) -> list[tuple[int, float]]:
        """(path number, similarity) of the k best under `similarity.category`, ties in path order."""
        best, scored = bounded_top(*self._search(query), k)
        self.scored += scored
        return best

    def improving(self, query: str, least: float) -> list[tuple[int, float]]:
        """(path number, similarity) of each path from `least` on that beats all paths before it; equal ones if their text sorts first."""
        bound, sharper, score = self._search(query)
        at = np.nonzero(bound >= least - 1e-9)[0]
        out: list[tuple[int, float]] = []
        for i, sharp in zip(at.tolist(), np.minimum(sharper(at), bound[at]).tolist()):
            if sharp < (out[-1][1] if out else least) - 1e-9:
                continue
            self.scored += 1
            s = score(i)
            if s >= least and (not out or (-s, self.paths[i]) < (-out[-1][1], self.paths[out[-1][0]])):
                out.append((i, s))
        return out

    def reaches(self, query: str, among: list[int], least: float) -> bool:
        """Whether one of the numbered paths is as similar as `least`."""
        if not among:
            return False
        bound, sharper, score = self._search(query)
        at = np.array(among)[bound[among] >= least - 1e-9]
        return len(at) > 0 and any(score(i) >= least for i in at[sharper(at) >= least - 1e-9].tolist())


def nearest_paths(k: int):
    """A finder for `scan` over paths."""

    def finder(paths):
        index = PathIndex(sorted(paths))
        return lambda texts: ((i, index.paths[at], score) for i, t in enumerate(texts) for at, score in index.top(t, k))

    return finder


def nearest_names(k: int):
    """A finder for `scan` over (key, name) entries: the k names nearest to each text, ties in the order of names."""

    def finder(entries):
        entries = sorted(entries, key=lambda e: (e[1].casefold(), e[1], e[0]))
        index = NameIndex([e[0] for e in entries])

        def find(texts):
            for i, t in enumerate(texts):
                for at, score in index.top(t, k):
                    yield i, index.keys[at], score / 100.0

        return find

    return finder
