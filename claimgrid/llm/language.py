"""Language ID by string kernels: blended-spectrum presence, Nystroem landmarks, one-versus-rest kernel ridge regression.

A text is the set of its character n-grams (n = 1 to ``NGRAMS``, letters lower-cased, runs of anything else one
space), hashed to 2**16 places (fewer where there are so many languages that the weights would pass ``MODEL_BYTES``). The kernel of two texts is the
number of places they share over the root of the product of their numbers. All languages are learned. Landmarks (``LANDMARKS`` in all) and training
texts (``PER_LANGUAGE`` rows of a language, ``SAMPLE`` rows and about ``SAMPLE_BYTES`` of places in all, at least one row of each language) are a bounded sample of the labelled rows, spread
evenly over the languages; all else covers every row. As the regression is linear in the landmark kernels, and
those in the presence bits, the landmark matrix and the coefficients are multiplied once and a batch of texts is
scored by one product of its (sparse) presence matrix with the result. No text is shuffled but those of the sample.

Cases: a null text, or one without a letter, is ``und`` with score 0; rows with a null or empty label teach nothing, and repeated ones teach once; with
no labelled row every text is ``und``; a null doc_id is not held out; repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, crc_mod, table, trimmed

DIM_BITS, LEAST_BITS = 16, 10
NGRAMS = 3
#: Bounds of the training sample: rows of a language, rows and bytes of places in all; of the landmarks of a language and in all; of the weights.
PER_LANGUAGE, SAMPLE, SAMPLE_BYTES = 600, 24_000, 128 << 20
LANDMARKS_EACH, LANDMARKS = 64, 1024
MODEL_BYTES = 64 << 20
#: Most languages whose shares are broadcast, a short row each.
LISTED = 100_000
SHARPNESS = 6.0
UND = "und"


@cache
def letters() -> np.ndarray:
    """Code point to its lower-case letter, or to a space if it is none."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x32000):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def bits_for(languages: int) -> int:
    """Bits of a place: as many as keep the weights of so many languages within MODEL_BYTES."""
    return max(LEAST_BITS, min(DIM_BITS, (MODEL_BYTES // (4 * max(1, languages))).bit_length() - 1))


def presence(text: str | None, bits: int = DIM_BITS) -> np.ndarray:
    """Sorted hashed places of the text's n-grams; empty if the text has no letter."""
    if not text:
        return np.zeros(0, np.int32)
    cp = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    space = cp == 32
    if space.all():
        return np.zeros(0, np.int32)
    cp = np.concatenate([[32], cp[~(space & np.concatenate([[True], space[:-1]]))], [32]]).astype(np.uint32)
    seen = np.zeros(1 << bits, bool)
    gram = cp.copy()
    for n in range(1, NGRAMS + 1):
        if n > 1:
            gram = gram[:-1] * np.uint32(0x01000193) + cp[n - 1 :]
        h = gram * np.uint32(0x9E3779B1) + np.uint32(n * 0x7F4A7C15 & 0xFFFFFFFF)
        seen[(h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - bits)] = True
    return np.flatnonzero(seen).astype(np.int32)


def rows_matrix(sets: list[np.ndarray], bits: int) -> np.ndarray:
    out = np.zeros((len(sets), 1 << bits), np.float32)
    for i, s in enumerate(sets):
        out[i, s] = 1 / np.sqrt(max(len(s), 1))
    return out


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # places x languages
    bias: np.ndarray
    bits: int = DIM_BITS

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        """Batched product of the presence matrix with the weights; rows hold no more than their set places."""
        flat = np.concatenate(sets) if sets else np.zeros(0, np.int32)
        sums = np.zeros((len(sets), len(self.languages)))
        full = [i for i, s in enumerate(sets) if len(s)]
        if full:
            at = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
            sums[full] = np.add.reduceat(self.weights[flat], at, axis=0) / np.sqrt([[len(sets[i])] for i in full])
        return sums + self.bias


def kernels(sets: list[np.ndarray], marks: list[np.ndarray], bits: int, step: int = 128) -> np.ndarray:
    """Kernel of each of ``sets`` with each landmark; dense in blocks only."""
    out = np.zeros((len(sets), len(marks)))
    for lo in range(0, len(marks), step):
        some = rows_matrix(marks[lo : lo + step], bits)
        for i in range(0, len(sets), step):
            out[i : i + step, lo : lo + step] = rows_matrix(sets[i : i + step], bits) @ some.T
    return out


def fit(sample: list[tuple[str, np.ndarray]], bits: int = DIM_BITS, landmarks_each: int = LANDMARKS_EACH, landmarks: int = LANDMARKS, ridge: float = 1e-3) -> Model:
    """Kernel ridge regression on Nystroem features of ``(language, presence)`` pairs; the first of each language are the landmarks, in turn."""
    languages = sorted({lang for lang, _ in sample})
    if not languages:
        return Model([], np.zeros((1 << bits, 0), np.float32), np.zeros(0), bits)
    index = {lang: i for i, lang in enumerate(languages)}
    own = np.array([index[lang] for lang, _ in sample])
    sizes, turn = np.zeros(len(languages), np.int64), []
    for k, i in enumerate(own):
        if sizes[i] < landmarks_each:
            turn.append((int(sizes[i]), k))
        sizes[i] += 1
    marks = [sample[k][1] for _, k in sorted(turn)[:landmarks]]
    values, vectors = np.linalg.eigh(kernels(marks, marks, bits))
    kept = values > 1e-6 * values.max()
    half = vectors[:, kept] / np.sqrt(values[kept])
    weight = 1 / sizes[own]
    weight = weight / weight.mean()  # languages weigh alike
    share = np.bincount(own, weight, minlength=len(languages)) / weight.sum()
    bias = 2 * share - 1
    gram, cross = ridge * len(sample) * np.eye(half.shape[1]), np.zeros((half.shape[1], len(languages)))
    for lo in range(0, len(sample), 256):
        x = kernels([s for _, s in sample[lo : lo + 256]], marks, bits) @ half
        w = weight[lo : lo + 256, None] * x
        gram += x.T @ w
        cross -= w.sum(axis=0)[:, None] * (1 + bias)  # targets are -1 but for the own language
        np.add.at(cross.T, own[lo : lo + 256], 2 * w)
    alpha = half @ np.linalg.solve(gram, cross)
    weights = np.zeros((1 << bits, len(languages)), np.float32)
    for s, a in zip(marks, alpha, strict=True):
        weights[s] += (a / np.sqrt(max(len(s), 1))).astype(np.float32)
    return Model(languages, weights, bias, bits)


def train(docs: DataFrame, keep: Column, per_language: int = PER_LANGUAGE, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fits on a sample, by a hash of doc_id and text, of the rows where ``keep`` holds: every language, and of each about as many rows as the bounds allow."""
    known = docs.where(keep & F.col("lang").isNotNull() & (F.col("lang") != "")).select("lang", "text", F.xxhash64("doc_id", "text", F.lit(6)).alias("h"))
    each = known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.least(F.lit(4 << DIM_BITS).cast("long"), F.lit(12) * F.coalesce(F.length("text"), F.lit(0)).cast("long"))).alias("bytes"), F.min("h").alias("first"))
    n_languages = each.count()
    if not n_languages:
        return fit([])
    bits = bits_for(n_languages)
    most = F.least(F.lit(per_language / 1.0), F.lit(sample / n_languages))
    share = F.least(F.lit(1.0), most / F.col("n"), F.lit(sample_bytes / n_languages) / F.greatest("bytes", F.lit(1)))
    shares = checkpoint(each.select(F.col("lang").alias("l"), share.alias("share"), "first"))
    shares = F.broadcast(shares) if n_languages <= LISTED else shares
    place = F.pmod("h", F.lit(1 << 40)).cast("double") / float(1 << 40)
    wanted = known.join(shares, F.col("lang") == F.col("l")).where((place < F.col("share")) | (F.col("h") == F.col("first"))).dropDuplicates(["lang", "h"])

    def sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array([presence(t, bits) for t in b.column("text").to_pylist()], pa.list_(pa.int32())), b.column("h")], names=["lang", "places", "h"])

    got = wanted.select("lang", "text", "h").mapInArrow(sets, "lang string, places array<int>, h long").toArrow().combine_chunks().sort_by("h")
    places = got.column("places").combine_chunks()
    flat, offsets = places.values.to_numpy(), places.offsets.to_numpy()
    rows = zip(got.column("lang").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
    return fit([(lang, flat[a:z]) for lang, a, z in rows if z > a], bits)


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of ``docs`` with lang_pred and score."""
    kinds = dict(docs.dtypes)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # MODEL_BYTES at most

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for whole in it:
            for lo in range(0, whole.num_rows, 128):
                b = whole.slice(lo, 128)
                sets = [presence(t, m.bits) for t in b.column("text").to_pylist()]
                lang, score = [UND] * len(sets), np.zeros(len(sets))
                if m.languages and sets:
                    s = m.scores(sets)
                    p = np.exp(SHARPNESS * (s - s.max(axis=1, keepdims=True)))
                    p /= p.sum(axis=1, keepdims=True)
                    best = s.argmax(axis=1)
                    for i, x in enumerate(sets):
                        if len(x):
                            lang[i], score[i] = m.languages[best[i]], p[i, best[i]]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(lang), pa.array(score)], names=[*keep, "lang_pred", "score"])

    return docs.select(*(c for c in keep if c != "text"), "text").mapInArrow(lambda it: trimmed(batches(it)), ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", lang_pred string, score double")


def op6_language(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row for each row of documents."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    found = predict(docs, train(docs, ~held))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
