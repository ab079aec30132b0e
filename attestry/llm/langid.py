"""Language identification by nearest centroid: TF-IDF of character n-grams, several centroids per language, cosine.

Document frequencies are counted over all training rows.  The centroids are
k-means clusters (by cosine) of a bounded sample of each language's training
rows, `sample` rows with the smallest keyed hash, fitted in one task per
language.  A text whose cosine with the nearest centroid is below what nearly
all training rows of that language reach is marked as rejected.

Cases: null texts and texts without a letter are `und`, score 0, rejected; long
texts are read whole; rows that repeat are treated row by row; languages with a
single training row get one centroid; without any training row every text is
`und`; extra columns are ignored; an empty table gives an empty table.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.common import held_out

UNKNOWN = "und"


@dataclass(frozen=True)
class LangParams:
    bins: int = 4096            # n-grams are hashed to so many dimensions
    sample: int = 400           # training rows per language that centroids are fitted on
    centroids: int = 4          # per language
    rounds: int = 12
    reject_share: float = 0.002  # share of the sample that may lie outside its language's radius
    slack: float = 0.9          # times the cosine at that share


def grams(text: str, bins: int) -> np.ndarray:
    """Counts of hashed 1-, 2- and 3-grams of the lower-cased letters; what is no letter separates words."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = (c >= 97) & (c <= 122) | (c >= 170)
    c = np.where(letter, c, np.uint32(32))
    c = np.concatenate(([np.uint32(32)], c, [np.uint32(32)]))
    keep = (c[1:] != 32) | (c[:-1] != 32)
    c = np.concatenate((c[:1], c[1:][keep])).astype(np.uint32)
    shift = np.uint32(32 - (bins.bit_length() - 1))
    one = c * np.uint32(2654435761)
    two = (one[:-1] ^ (c[1:] * np.uint32(2246822519))) * np.uint32(3266489917)
    three = (two[:-1] ^ (c[2:] * np.uint32(668265263))) * np.uint32(374761393)
    return np.bincount(np.concatenate([one >> shift, two >> shift, three >> shift]).astype(np.int64), minlength=bins)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    """Unit vectors of log term frequency times inverse document frequency."""
    tf = np.stack([grams(t, len(idf)) for t in texts]) if texts else np.zeros((0, len(idf)))
    v = np.log1p(tf) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _frequencies(rows: DataFrame, bins: int) -> tuple[np.ndarray, int]:
    """Number of rows that hold each bin, and of rows: one row per bin and input partition is shuffled."""

    def count(batches):
        seen = np.zeros(bins + 1, np.int64)
        for batch in batches:
            for t in batch.column(0):
                seen[:bins] += grams(t.as_py(), bins) > 0
                seen[bins] += 1
        at = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["bin", "n"])

    total = np.zeros(bins + 1, np.int64)
    for r in rows.select("text").mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        total[r["bin"]] = r["n"]                 # at most bins + 1 rows
    return total[:bins], int(total[bins])


def cluster(v: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means; starts from the mean's farthest rows, so it is the same on every run."""
    unit = lambda x: x / max(np.linalg.norm(x), 1e-12)
    centres = [unit(v.mean(axis=0))]
    while len(centres) < min(k, len(v)):
        centres.append(v[int(np.argmin((v @ np.stack(centres).T).max(axis=1)))])
    centres = np.stack(centres)
    for _ in range(rounds):
        own = (v @ centres.T).argmax(axis=1)
        centres = np.stack([unit(v[own == i].mean(axis=0)) if (own == i).any() else centres[i] for i in range(len(centres))])
    return centres


@dataclass
class LangModel:
    langs: list[str]            # language of each centroid
    centroids: np.ndarray
    radius: np.ndarray          # least cosine that is not rejected, per centroid
    idf: np.ndarray


def train(docs: DataFrame, p: LangParams = LangParams()) -> LangModel:
    """Learn from all rows given: (doc_id, text, lang)."""
    rows = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    df, n = _frequencies(rows, p.bins)
    idf = np.log((1 + n) / (1 + df)) + 1.0
    # rows whose keyed hash is low enough for a few times the sample; only those are ranked
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}     # one row per language
    draw = F.xxhash64(F.lit("lang"), "doc_id")
    share = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, 4.0 * p.sample / n)])[F.col("lang")] if sizes else F.lit(1.0)
    order = Window.partitionBy("lang").orderBy("draw", "doc_id")
    picked = rows.select("doc_id", "lang", draw.alias("draw")).where(F.shiftrightunsigned(draw, 11) / float(2 ** 53) < share)    # in the scan, before any shuffle
    picked = picked.withColumn("at", F.row_number().over(order)).where(F.col("at") <= p.sample)
    picked = picked.select("doc_id", "lang").distinct()      # at most `sample` short rows per language
    sample = rows.join(F.broadcast(picked), ["doc_id", "lang"])

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[[has_letter(t) for t in pdf["text"]]]
        v = vectors(pdf["text"].tolist(), idf)
        if not len(v):
            return pd.DataFrame({"lang": [], "at": [], "centre": [], "radius": []})
        c = cluster(v, p.centroids, p.rounds)
        best = (v @ c.T).max(axis=1)
        radius = float(np.quantile(best, p.reject_share)) * p.slack
        return pd.DataFrame({"lang": key[0], "at": range(len(c)), "centre": list(c), "radius": radius})

    fitted = sample.groupBy("lang").applyInPandas(fit, "lang string, at int, centre array<double>, radius double").collect()
    fitted = sorted(fitted, key=lambda r: (r["lang"], r["at"]))
    return LangModel([r["lang"] for r in fitted], np.array([r["centre"] for r in fitted]).reshape(len(fitted), p.bins),
                     np.array([r["radius"] for r in fitted]), idf)


def predict(docs: DataFrame, model: LangModel) -> DataFrame:
    """(doc_id, lang_pred, score, rejected); the score is the cosine with the nearest centroid."""
    langs = np.array([*model.langs, UNKNOWN], dtype=object)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts = part.column(1).to_pylist()
                use = np.array([i for i, t in enumerate(texts) if model.langs and has_letter(t)], dtype=np.int64)
                best, score, far = np.full(len(texts), len(langs) - 1), np.zeros(len(texts)), np.ones(len(texts), bool)
                if len(use):
                    cosine = vectors([texts[i] for i in use], model.idf) @ model.centroids.T
                    best[use] = cosine.argmax(axis=1)
                    score[use] = np.clip(cosine.max(axis=1), 0.0, 1.0)
                    far[use] = score[use] < model.radius[best[use]]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs[best].tolist(), pa.string()), pa.array(score), pa.array(far)],
                                                 ["doc_id", "lang_pred", "score", "rejected"])

    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean"
    return docs.select("doc_id", "text").mapInArrow(run, kind)


def identify(docs: DataFrame, p: LangParams = LangParams()) -> DataFrame:
    """Learn from the rows that are not held out, predict for all: (doc_id, held_out, lang_pred, score, rejected)."""
    model = train(docs.where(~held_out(F.col("doc_id"))), p)
    found = predict(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
