"""Quality by nearest-neighbour voting among labelled documents in a latent-semantic space.

Terms of a whole text are hashed character trigrams, 4-grams over character classes (the shape of the
writing) and the share of words that repeat the word before. Counts are damped and weighted by inverse
document frequency, the kinds are scaled to one length each, and a truncated singular value decomposition
of the labelled sample gives the latent space. Every document's vector is compared exactly, block by block,
with all labelled vectors; its NEIGHBOURS nearest vote with the weight of their similarity, and the score
is label 1's part of the votes. Similarities are computed in double precision and rounded to DIGITS digits, so that a text
has one score, whatever texts it is worked on with; of equally near neighbours those of label 0 come first, then those
with the smaller doc_id.

Bounds. The labelled sample holds at most SAMPLE rows a label (those with the smallest hashes of doc_id), so
that what is broadcast is at most 2 x SAMPLE vectors of RANK floats plus the projection, about 2 MB at the
defaults, whatever the corpus holds. The driver gets their counts packed and works on one table of them, 40 MB at the
defaults, that the weights overwrite. All documents are scored, with their whole texts; nothing is shuffled
but the labelled rows. Frequencies come from the labelled sample, as a part of the fitted model.

Cases. A null text is empty; an empty text is scored like any other (its vector is zero, so its score is
the labelled share of 1). Labels may miss, be null or come twice (then the smaller one holds). Without any
labelled row the score is 0.5. Repeated rows and null ids are kept. An empty table gives no rows. Further
columns stay, except those named like the output's.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import table

SAMPLE = 1500
RANK = 48
NEIGHBOURS = 25
THRESHOLD = 0.3
GRAMS = 2048
SHAPES = 6**4
DIMS = GRAMS + SHAPES + 1
#: Digits of a similarity.
DIGITS = 9
#: Characters and texts that are worked on at once.
BLOCK, TEXTS = 500_000, 256
#: Vote weight: similarity to this power.
SHARPNESS = 4
#: What the three kinds of terms weigh.
WEIGHTS = (0.4, 1.0, 1.5)


def _classes() -> np.ndarray:
    out = np.full(256, 4, dtype=np.int64)  # marks
    out[[9, 10, 11, 12, 13, 32]] = 0
    out[97:123], out[65:91], out[48:58], out[128:] = 1, 2, 3, 5
    return out


_CLASS = _classes()


def counts(texts: list[str]) -> np.ndarray:
    """A row of raw term counts (and the repetition share) for each text."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    out = np.zeros((len(raw), DIMS), dtype=np.float32)
    lens = np.array([len(r) for r in raw], dtype=np.int64)
    b = np.frombuffer(b"".join(raw), dtype=np.uint8)
    if not len(b):
        return out
    doc = np.repeat(np.arange(len(raw)), lens)

    def tally(codes: np.ndarray, size: int, width: int) -> np.ndarray:
        inside = doc[: len(codes)] == doc[width - 1 :]
        return np.bincount(doc[: len(codes)][inside] * size + codes[inside], minlength=len(raw) * size).reshape(len(raw), size)

    if len(b) >= 4:
        w = b.astype(np.uint32)
        mixed = (w[:-2] * np.uint32(0x9E3779B1)) ^ (w[1:-1] * np.uint32(0x85EBCA6B)) ^ (w[2:] * np.uint32(0xC2B2AE35))
        out[:, :GRAMS] = tally(((mixed * np.uint32(0x27D4EB2F)) >> np.uint32(21)).astype(np.int64), GRAMS, 3)
        c = _CLASS[b]
        out[:, GRAMS : GRAMS + SHAPES] = tally(((c[:-3] * 6 + c[1:-2]) * 6 + c[2:-1]) * 6 + c[3:], SHAPES, 4)
    # words: their hash is a sum over place-weighted bytes from the word's start
    letter = _CLASS[b] != 0
    starts = letter & np.r_[True, ~letter[:-1] | (doc[1:] != doc[:-1])]
    at = np.flatnonzero(starts)
    if len(at) > 1:
        owner = doc[at]
        place = np.arange(len(b)) - np.repeat(at, np.diff(np.r_[at, len(b)]))[-len(b) :] if at[0] == 0 else None
        if place is None:
            place = np.zeros(len(b), dtype=np.int64)
            place[at[0] :] = np.arange(at[0], len(b)) - np.repeat(at, np.diff(np.r_[at, len(b)]))
        value = np.where(letter, (b.astype(np.uint64) + np.uint64(1)) * ((place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), np.uint64(0))
        hashed = np.add.reduceat(value, at)
        again = (hashed[1:] == hashed[:-1]) & (owner[1:] == owner[:-1])
        repeats = np.bincount(owner[1:][again], minlength=len(raw))
        words = np.bincount(owner, minlength=len(raw))
        out[:, -1] = np.sqrt(repeats / np.maximum(words, 1))
    return out


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def weighted(self, x: np.ndarray) -> np.ndarray:
        out = np.sqrt(x) * self.idf
        for lo, hi, weight in ((0, GRAMS, WEIGHTS[0]), (GRAMS, GRAMS + SHAPES, WEIGHTS[1])):
            norm = np.linalg.norm(out[:, lo:hi], axis=1, keepdims=True)
            out[:, lo:hi] *= weight / np.maximum(norm, 1e-9)
        out[:, -1] = x[:, -1] * WEIGHTS[2]
        return out

    def latent(self, x: np.ndarray) -> np.ndarray:
        return self.projected(self.weighted(x))

    def projected(self, w: np.ndarray) -> np.ndarray:
        z = w.astype(np.float64) @ self.axes.astype(np.float64)
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(x), self.prior)
        near = np.round(self.latent(x) @ self.vectors.T.astype(np.float64), DIGITS)
        n = near.shape[1]
        k = min(NEIGHBOURS, n)
        # one key tells similarity and then place; vectors stand in order of label and doc_id
        key = (near * 10**DIGITS).round().astype(np.int64) * n - np.arange(n)
        top = np.argpartition(-key, k - 1, axis=1)[:, :k]
        top.sort(axis=1)  # votes are added in one order
        weight = np.maximum(np.take_along_axis(near, top, axis=1), 0) ** SHARPNESS
        total = weight.sum(axis=1)
        votes = (weight * self.labels[top]).sum(axis=1)
        return np.where(total > 0, votes / np.maximum(total, 1e-12), self.prior)


def fit(x: np.ndarray, labels: np.ndarray, seed: int = 5) -> Model:
    """The model of a labelled sample's raw counts, which are overwritten; randomised subspace iteration for the axes."""
    if not len(labels):
        return Model(np.ones(DIMS, np.float32), np.zeros((DIMS, 1), np.float32), np.zeros((0, 1), np.float32), labels, 0.5)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    model = Model(idf, np.zeros((DIMS, 1), np.float32), np.zeros((0, 1), np.float32), labels.astype(np.float64), float(labels.mean()))
    blocks = [slice(lo, lo + TEXTS) for lo in range(0, len(x), TEXTS)]
    w = x  # in place: the driver holds one table of this size
    for block in blocks:
        w[block] = model.weighted(x[block])
    rank = min(RANK, *w.shape)
    q = np.linalg.qr(w.T @ np.random.default_rng(seed).standard_normal((len(w), rank)).astype(np.float32))[0]
    for _ in range(6):
        q = np.linalg.qr(w.T @ (w @ q))[0]
    model.axes = q.astype(np.float32)
    model.vectors = np.concatenate([model.projected(w[block]).astype(np.float32) for block in blocks])
    return model


def bucket(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5; rows where it is 0 are held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % 5


def sample(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Raw counts and labels of at most per_label rows a label, none of them held out."""
    marked = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marked = marked.where(bucket(F.col("doc_id")) != 0).select("doc_id", "quality", F.xxhash64("doc_id").alias("h"))
    picked = [marked.where(F.col("quality") == q).orderBy("h", "doc_id").limit(per_label) for q in (0, 1)]
    chosen = picked[0].unionByName(picked[1])
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # 2 x per_label rows

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 200):
                part = batch.iloc[lo : lo + 200]
                x = counts(part["text"].tolist())
                yield pd.DataFrame({"doc_id": part["doc_id"], "quality": part["quality"], "x": [r.tobytes() for r in x]})

    rows = texts.mapInPandas(featurise, "doc_id long, quality int, x binary")
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(x=[zlib.compress(x, 1) for x in batch["x"]])

    # most counts are 0, so packed rows are a small part of the table that they fill on the driver
    rows = rows.mapInPandas(pack, "doc_id long, quality int, x binary").collect()
    rows.sort(key=lambda r: (r.quality, r.doc_id))
    x = np.zeros((len(rows), DIMS), dtype=np.float32)
    for k, r in enumerate(rows):
        x[k] = np.frombuffer(zlib.decompress(r.x), dtype=np.float32)
    return x, np.array([r.quality for r in rows], dtype=np.int64)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score and predicted; texts are worked on in blocks of about BLOCK characters."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = held.value
        for texts in batches:
            out, group, size = [], [], 0
            for t in texts:
                group.append(t)
                size += len(t)
                if size >= BLOCK or len(group) >= TEXTS:
                    out.append(m.score(counts(group)))
                    group, size = [], 0
            if group:
                out.append(m.score(counts(group)))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    docs = docs.withColumn("score", scored(F.coalesce("text", F.lit(""))))
    return docs.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(*sample(docs, labels)))


def op7_neighbour_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = classify(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", (bucket(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
