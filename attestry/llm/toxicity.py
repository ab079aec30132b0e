"""Toxic passages as maximum-scoring segments of token log-odds, calibrated as extreme values.

Tokens (words and their stems, whichever says more) are scored by the log-odds of toxic against clean labelled texts that
hold them, with the whole corpus as Dirichlet prior, drawn towards zero by
their standard error.  A linear scan finds all maximal scoring
segments of a text (Ruzzo and Tompa 1999).  The best segment of a clean text of
n tokens follows an extreme-value law, P(S >= s) = 1 - exp(-K n exp(-lambda s)):
lambda solves sum p(token) exp(lambda * score) = 1 over clean tokens, K is
fitted on clean texts, so that evidence is comparable for every length.  A
logistic curve over that evidence, fitted on the labelled sample, gives the
score.

Counts are held in two tables of `bins`, by the two halves of a 32-bit token
hash; a token's score is the smaller of its two, so that it takes two
collisions for a clean token to look toxic.

Cases: null and empty texts have no segment and the score of no evidence; texts
are read whole; labels that repeat an id count once, with their highest value;
null labels are ignored; without labelled rows of both kinds nothing is toxic;
extra columns are ignored; an empty table gives an empty table.
"""

import zlib
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import first_by_hash, held_out
from attestry.llm.tokens import parts

_FOLD = bytes.maketrans(b"""ABCDEFGHIJKLMNOPQRSTUVWXYZ!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~""",
                        b"abcdefghijklmnopqrstuvwxyz" + b" " * 32)


#: bytes of the stems: a token is also known by its first letters
STEMS = (4, 6)


@dataclass(frozen=True)
class ToxicParams:
    bins: int = 65536
    sample: int = 8000          # labelled rows of each kind that the model is fitted on, by smallest keyed hash
    prior: float = 0.1          # texts the prior weighs as much as, for each labelled text
    doubt: float = 3.0          # standard errors by which log-odds are drawn towards zero
    drift: float = 0.2          # taken off each token's log-odds: what a token must say to lengthen a passage
    unlikely: float = 1e-3      # a passage is reported if a clean text has one as good with at most this probability
    cut: float = 0.3


def hashes(text: str) -> np.ndarray:
    """Three 32-bit hashes of each token (a run of lower-cased letters, digits and other non-ASCII characters): of the whole
    token, of its stem and of its longer stem."""
    words = text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split()
    kinds = [map(zlib.crc32, words), *[map(zlib.crc32, [w[:n] for w in words], repeat(n)) for n in STEMS]]
    return np.stack([np.fromiter(k, dtype=np.uint32, count=len(words)) for k in kinds])


def halves(h: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    return (h % np.uint32(bins)).astype(np.int64), (h >> np.uint32(16)).astype(np.int64) % bins + bins


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score) in one pass; neighbours of one sign are merged first."""
    if not len(scores) or not (scores > 0).any():
        return []
    sign = scores > 0
    edges = np.concatenate(([0], np.nonzero(sign[1:] != sign[:-1])[0] + 1, [len(scores)]))
    sums = np.add.reduceat(scores, edges[:-1])
    total = np.concatenate(([0.0], np.cumsum(sums))).tolist()
    first = 0 if sign[0] else 1
    edges = edges.tolist()
    found: list[list] = []      # start, end, total before, total after, nearest earlier one that began lower
    for k in range(first, len(sums), 2):
        start, end, left, right = edges[k], edges[k + 1], total[k], total[k + 1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                found.append([start, end, left, right, j])
                break
            start, left = found[j][0], found[j][2]
            del found[j:]
    return [(s, e, r - l) for s, e, l, r, _ in found]


@dataclass
class ToxicModel:
    weights: np.ndarray         # both tables, one after the other
    rate: float                 # lambda
    log_k: float
    curve: tuple[float, float, float]
    p: ToxicParams

    def token_scores(self, text: str) -> np.ndarray:
        a, b = halves(hashes(text), self.p.bins)
        return np.minimum(self.weights[a], self.weights[b]).max(axis=0)

    def surprise(self, score: float, n: int) -> float:
        """Minus the log of the probability that a clean text of n tokens has a segment this good."""
        x = self.log_k + np.log(max(n, 1)) - self.rate * score
        return float(-x if x < -30 else -np.log(max(-np.expm1(-np.exp(min(x, 30.0))), 1e-300)))

    def evidence(self, text: str) -> tuple[float, float, list[tuple[int, int, float]]]:
        """Surprise of the best segment, of all reported ones together, and those (token range and surprise)."""
        scores = self.token_scores(text)
        rated = [(s, e, self.surprise(v, len(scores))) for s, e, v in segments(scores)]
        limit = -np.log(self.p.unlikely)
        reported = [x for x in rated if x[2] >= limit]
        return max([x[2] for x in rated], default=0.0), sum(x[2] for x in reported), reported

    def probability(self, best: float, together: float) -> float:
        a, b, c = self.curve
        return float(1.0 / (1.0 + np.exp(-np.clip(a + b * np.log1p(best) + c * np.log1p(together), -30, 30))))


def _labelled(docs: DataFrame, labels: DataFrame, p: ToxicParams) -> DataFrame:
    """(doc_id, toxic): a bounded sample of the labelled ids, the same on every run; held-out ids are never in it."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id")))
    return first_by_hash(known.where("toxic = 1"), "doc_id", p.sample, "toxic").union(first_by_hash(known.where("toxic = 0"), "doc_id", p.sample, "toxic"))


def _counts(docs: DataFrame, sample: DataFrame, bins: int) -> np.ndarray:
    """Numbers of texts (all, clean sample, toxic sample) that hold each bin of either table, and at the end of all texts;
    one row per bin and input partition is shuffled."""

    def count(batches):
        n = np.zeros((3, 2 * bins + 1), np.int64)
        held: list[list] = [[], [], []]

        def add():
            for own, total in zip(held, n):
                if own:
                    total += np.bincount(np.concatenate(halves(np.concatenate(own), bins)), minlength=2 * bins + 1)
                own.clear()

        for batch in parts(batches):
            size = 0
            for t, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                own = np.unique(hashes(t.as_py() or ""))
                for k in (0,) if toxic is None else (0, 1 + toxic):
                    held[k].append(own)
                    n[k, -1] += 1
                size += len(own)
                if size > 2_000_000:
                    add()
                    size = 0
            add()
        at = np.nonzero(n[0])[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(x[at]) for x in n]], ["bin", "everywhere", "clean", "toxic"])

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id", "left").select("text", "toxic")
    summed = rows.mapInArrow(count, "bin long, everywhere long, clean long, toxic long").groupBy("bin").agg(
        F.sum("everywhere"), F.sum("clean"), F.sum("toxic")).toPandas().to_numpy()      # at most 2 * bins + 1 rows
    total = np.zeros((3, 2 * bins + 1))
    if len(summed):
        total[:, summed[:, 0].astype(np.int64)] = summed[:, 1:].T
    return total


def _prior(total: np.ndarray, p: ToxicParams) -> np.ndarray:
    """Pseudo-texts that hold each bin: the same share of them as of all texts."""
    return _pseudo(total, p) * (total[0, :-1] + 0.01) / (total[0, -1] + 1.0)


def _pseudo(total: np.ndarray, p: ToxicParams) -> float:
    return max(10.0, p.prior * (total[1, -1] + total[2, -1]))


def _weights(total: np.ndarray, p: ToxicParams) -> np.ndarray:
    """Log-odds of toxic against clean with the corpus as Dirichlet prior, drawn towards zero by `doubt` standard errors, less the drift."""
    alpha, (clean, toxic) = _prior(total, p), total[1:, :-1]
    odds = lambda c, n: np.log((c + alpha) / (n + _pseudo(total, p) - c - alpha).clip(0.5))
    delta = odds(toxic, total[2, -1]) - odds(clean, total[1, -1])
    error = np.sqrt(1 / (toxic + alpha) + 1 / (clean + alpha))
    return np.sign(delta) * np.maximum(np.abs(delta) - p.doubt * error, 0.0) - p.drift


def _rate(weights: np.ndarray, clean: np.ndarray, bins: int) -> float:
    """lambda > 0 with mean exp(lambda * score) = 1 over the tokens of clean texts and the prior, by bisection."""
    share = clean[:bins] / max(clean[:bins].sum(), 1e-9)
    f = lambda x: float((share * np.exp(np.clip(x * weights[:bins], -700, 700))).sum())
    low, high = 1e-3, 1e-3
    while f(high) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 1 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Newton's method with a small penalty; both slopes stay at or above zero."""
    x, w = np.column_stack([np.ones(len(x)), x]), np.zeros(3)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - q) - 0.1 * w
        w = w + np.clip(np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(3), g), -2, 2)
    return float(w[0]), float(max(w[1], 0.0)), float(max(w[2], 0.0))


def train(docs: DataFrame, labels: DataFrame, p: ToxicParams = ToxicParams()) -> ToxicModel:
    sample = _labelled(docs, labels, p)
    sample = docs.sparkSession.createDataFrame([tuple(r) for r in sample.collect()], sample.schema)     # at most 2 * p.sample rows
    total = _counts(docs, sample, p.bins)
    if not total[1, -1] or not total[2, -1]:
        return ToxicModel(np.full(2 * p.bins, -1.0), 1.0, 0.0, (-5.0, 0.0, 0.0), p)
    weights = _weights(total, p)
    model = ToxicModel(weights, _rate(weights, total[1, :-1] + _prior(total, p), p.bins), 0.0, (0.0, 0.0, 0.0), p)

    def best(batches):
        for batch in parts(batches):
            rows = []
            for t, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                scores = model.token_scores(t.as_py() or "")
                rows.append((toxic, len(scores), max((s for _, _, s in segments(scores)), default=0.0)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.float64()))], ["toxic", "n", "best"])

    def both(batches):
        for batch in parts(batches):
            rows = [(toxic, *model.evidence(t.as_py() or "")[:2]) for t, toxic in zip(batch.column(0), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.float64(), pa.float64()))], ["toxic", "best", "together"])

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic")      # bounded as the sample is
    seen = rows.where("toxic = 0").mapInArrow(best, "toxic int, n long, best double").where("n > 0").collect()
    clean = sorted(model.rate * r["best"] - np.log(r["n"]) for r in seen)
    model.log_k = float(np.mean(clean) - 0.5772156649) if clean else 0.0       # the mean of a Gumbel law is ln(K n) + gamma, over lambda
    points = sorted((r["toxic"], r["best"], r["together"]) for r in rows.where("text <> ''").mapInArrow(both, "toxic int, best double, together double").collect())
    model.curve = (-5.0, 0.0, 0.0) if not points else _logistic(np.log1p(np.array([x[1:] for x in points])), np.array([float(t) for t, _, _ in points]))
    return model


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """(doc_id, score, passages, predicted): passages are token ranges with their surprise."""

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("surprise", pa.float64())]))
        for batch in parts(batches):
            found = [model.evidence(t.as_py() or "") for t in batch.column(1)]
            scores = [model.probability(best, together) for best, together, _ in found]
            passages = [[{"start": s, "end": e, "surprise": v} for s, e, v in own] for _, _, own in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(passages, kind)], ["doc_id", "score", "passages"])

    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, passages array<struct<start:int,end:int,surprise:double>>"
    found = docs.select("doc_id", "text").mapInArrow(run, kind)
    return found.withColumn("predicted", F.when(F.col("score") >= model.p.cut, 1).otherwise(0))


def detect(docs: DataFrame, labels: DataFrame, p: ToxicParams = ToxicParams()) -> DataFrame:
    """Learn from labelled rows that are not held out, score all: (doc_id, held_out, score, predicted, n_passages)."""
    found = score(docs, train(docs, labels, p))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def without_toxic(docs: DataFrame, labels: DataFrame, p: ToxicParams = ToxicParams()) -> DataFrame:
    """The documents whose score is below the cut, scored where they are: nothing is joined or moved."""
    model = train(docs, labels, p)

    def keep(batches):
        for batch in parts(batches):
            texts = batch.column(batch.schema.get_field_index("text"))
            ok = [model.probability(*model.evidence(t.as_py() or "")[:2]) < p.cut for t in texts]
            yield batch.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
