"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader updates, sparse dot products.

Words are runs of letters, runs of digits and runs of other signs, case kept; the features are the distinct words and word
pairs, hashed to ``DIM`` places, scaled to length 1, and two places of value 1 for the share of words that repeat one of the
two before them and the share of signs (both in steps, as hashed n-grams alone don't tell a repeated word from a used one). FTRL-proximal passes over a bounded sample of the labelled rows
(``SAMPLE`` at most, by a hash of doc_id; of rows that share a doc_id that with the least hash of its text teaches); every row of the table is scored over its whole text, without a shuffle of texts.

Cases: null and empty texts have no feature and get the score of the intercept; rows with a null label teach nothing, nor
do labels of unknown documents; without labels every score is 0.5; a null doc_id is not held out; a document labelled twice alike teaches
once; repeated rows each get a row.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, table

DIM_BITS = 18
DIM = 1 << DIM_BITS
SAMPLE = 6000
#: Upper ends of the steps of the two shares.
STEPS = (0.0, 0.01, 0.03, 0.06, 0.1, 0.2, 0.35, 0.5, 0.75)
EXTRA = 2 * (len(STEPS) + 1)
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
CACHE = 200_000


class Hashes(dict):
    """Word to its 32-bit hash; emptied when it has CACHE words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return h


_HASHES = Hashes()


def features(text: str | None) -> np.ndarray:
    """Sorted places: hashed distinct words and word pairs below DIM, then one step of each share."""
    words = TOKEN.findall(text or "")
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint32, len(words))
    pairs = (h[:-1] * np.uint32(0x9E3779B1)) ^ (h[1:] * np.uint32(0x85EBCA6B) + np.uint32(1))
    both = np.concatenate([h, pairs])
    places = np.unique(((both ^ (both >> np.uint32(16))) * np.uint32(0x45D9F3B1)) >> np.uint32(32 - DIM_BITS)).astype(np.int32)
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    again[2:] |= h[2:] == h[:-2]
    signs = sum(not w[0].isalnum() for w in words)
    steps = [bisect_left(STEPS, x / max(len(words), 1)) for x in (float(again.sum()), float(signs))]
    return np.concatenate([places, [DIM + steps[0], DIM + len(STEPS) + 1 + steps[1]]]).astype(np.int32)


def values(places: np.ndarray) -> np.ndarray:
    n = len(places) - 2
    return np.concatenate([np.full(n, 1 / np.sqrt(max(n, 1))), [1.0, 1.0]])


class Ftrl:
    """FTRL-proximal logistic regression over sparse rows."""

    def __init__(self, dim: int = DIM, alpha: float = 1.0, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(dim + EXTRA + 1), np.zeros(dim + EXTRA + 1)  # the last is the intercept

    def at(self, i: np.ndarray) -> np.ndarray:
        z = self.z[i]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2))

    def update(self, places: np.ndarray, label: int) -> None:
        i = np.append(places, len(self.z) - 1)
        x = np.append(values(places), 1.0)
        w = self.at(i)
        g = (1 / (1 + np.exp(-float(np.clip(w @ x, -35, 35)))) - label) * x
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[i] = n + g * g

    def weights(self) -> np.ndarray:
        return self.at(np.arange(len(self.z)))


def fit(rows: list[tuple[np.ndarray, int]], passes: int = 4, seed: int = 7) -> np.ndarray:
    model, rng = Ftrl(), np.random.default_rng(seed)
    for _ in range(passes):
        for k in rng.permutation(len(rows)):
            model.update(*rows[k])
    return model.weights()


def train(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "quality", sample: int = SAMPLE) -> np.ndarray:
    """Weights, the intercept last, from at most ``sample`` labelled rows of ``docs`` whose label satisfies ``keep`` (over doc_id)."""
    known = labels.where(keep & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id", "label").limit(sample)

    def sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array([features(t).tolist() for t in b.column("text").to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "label", "places"])

    held = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min_by(F.struct("text"), F.xxhash64("text")).alias("x"))
    rows = held.select("doc_id", "label", "x.text").mapInArrow(sets, f"doc_id {dict(docs.dtypes)['doc_id']}, label int, places array<int>").toArrow()
    rows = sorted(rows.to_pylist(), key=lambda r: (r["doc_id"], r["label"], r["places"]))
    return fit([(np.array(r["places"], np.int64), int(r["label"] == 1)) for r in rows])


def score(docs: DataFrame, weights: np.ndarray, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of ``docs`` with the score of each whole text."""
    kinds, sent = dict(docs.dtypes), docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for b in it:
            z = np.array([w[f] @ values(f) for f in map(features, b.column("text").to_pylist())]) + w[-1]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(1 / (1 + np.exp(-np.clip(z, -35, 35))))], names=[*keep, "score"])

    return docs.select(*(c for c in keep if c != "text"), "text").mapInArrow(batches, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", score double")


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of documents."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    found = score(docs, train(docs, table(spark, sf_dir, "labels"), ~held))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
