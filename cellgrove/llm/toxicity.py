"""Toxicity by subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is the bag of itself and its character n-grams, hashed into one embedding table; a passage is
the mean of its words' means; a linear softmax over that mean gives its logit. A document's logit is
that of its most toxic run of words, and training sends the gradient through that run, so that a few
words in a long text aren't averaged away. Words never seen share the vectors of their n-grams.
A last step fits scale and offset on the training documents' logits.

As the softmax is linear, a word's share of a logit is one number; scoring needs just that number
for each n-gram, and keeps it for words met again.

Null and empty texts get the logit of no words. Labels that are null are not learned from; a document
with several labels is toxic if any says so. Rows without doc_id count as held out. With no labels,
every score is 0. Of equally toxic runs either counts. Very long texts are scored whole, run by run; only those
of bounded length are learned from. Repeated rows are learned from each. Extra columns are not read.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .decontaminate import normal_words

BUCKETS = 1 << 18
GRAMS = (3, 4, 5, 6)
RUN = 5


def words_in(text: str | None) -> list[bytes]:
    return normal_words((text or "").lower().encode("utf-8", "replace"))


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' n-grams and whole forms, and the index of the word that each belongs to."""
    marked = [b"<" + w + b">" for w in words]
    size = np.array([len(w) for w in marked], np.int64)
    data = np.frombuffer(b"".join(marked), np.uint8)
    start = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(words), dtype=np.int32), size)
    buckets = [(common.span_hashes(data, start[:-1], start[1:]) & np.uint64(BUCKETS - 1)).astype(np.int32)]
    owners = [np.arange(len(words), dtype=np.int32)]
    c = data.astype(np.uint32) + np.uint32(1)
    for n in GRAMS:
        m = len(c) - n + 1
        if m <= 0:
            break
        h = np.full(m, n * 7919, np.uint32)
        for k in range(n):
            h = h * np.uint32(0x01000193) + c[k : k + m] * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        inside = owner[:m] == owner[n - 1 :]
        buckets.append((h & np.uint32(BUCKETS - 1)).astype(np.int32)[inside])
        owners.append(owner[:m][inside])
    return np.concatenate(buckets), np.concatenate(owners)


def _subwords_of(words: list[bytes], step: int = 50_000) -> tuple[np.ndarray, np.ndarray]:
    """subwords of many words, some at a time."""
    parts = [subwords(words[i : i + step]) for i in range(0, len(words), step)]
    return np.concatenate([b for b, _ in parts]), np.concatenate([o + np.int32(i * step) for i, (_, o) in enumerate(parts)])


def word_means(words: list[bytes], share: np.ndarray) -> np.ndarray:
    """For each word the mean of share over its subwords."""
    if not words:
        return np.zeros(0)
    buckets, owners = subwords(words)
    return np.bincount(owners, share[buckets], len(words)) / np.bincount(owners, minlength=len(words))


def run_means(values: np.ndarray) -> np.ndarray:
    """Means of all runs of RUN values; of all of them, where there are fewer."""
    width = min(RUN, len(values))
    total = np.concatenate([[0.0], np.cumsum(values)])
    return (total[width:] - total[:-width]) / width


class Model:
    """embeddings, the difference of the softmax's two rows and offsets, and the last step's scale and offset."""

    def __init__(self, embeddings: np.ndarray, weight: np.ndarray, bias: float, scale: float, offset: float):
        self.embeddings, self.weight, self.bias, self.scale, self.offset = embeddings, weight, bias, scale, offset

    def scorer(self) -> Scorer:
        return Scorer((self.embeddings @ self.weight).astype(np.float32), self.bias, self.scale, self.offset)


class Scorer:
    """What is left of a model for scoring. kept: the most words whose value is kept at once."""

    def __init__(self, share: np.ndarray, bias: float, scale: float, offset: float, kept: int = 400_000):
        self.share, self.bias, self.scale, self.offset, self.kept = share, bias, scale, offset, kept
        self.known: dict[bytes, float] = {}

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for i in range(0, len(texts), 256):
            docs = [words_in(t) for t in texts[i : i + 256]]
            if len(self.known) > self.kept:
                self.known.clear()
            new = list({w for ws in docs for w in ws}.difference(self.known))
            for k in range(0, len(new), 50_000):
                self.known.update(zip(new[k : k + 50_000], word_means(new[k : k + 50_000], self.share).tolist(), strict=True))
            for j, ws in enumerate(docs):
                z = float(run_means(np.fromiter(map(self.known.__getitem__, ws), float, len(ws))).max()) if ws else 0.0
                out[i + j] = (z + self.bias) * self.scale + self.offset
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def train(texts: list[str], toxic: np.ndarray, dims: int = 8, epochs: int = 80, rate: float = 0.05, decay: float = 3e-5, rarest: int = 5, seed: int = 11) -> Model | None:
    """Joint training by Adam on full batches.

    Subwords met in fewer than `rarest` documents (counted by word) keep a zero vector, and decay draws all vectors to zero."""
    docs = [words_in(t) for t in texts]
    keep = [i for i, ws in enumerate(docs) if ws]
    docs, y = [docs[i] for i in keep], np.asarray(toxic, float)[keep]
    if not docs or y.min() == y.max():
        return None
    index: dict[bytes, int] = {}
    length = np.array([len(ws) for ws in docs])
    tokens = np.fromiter((index.setdefault(w, len(index)) for ws in docs for w in ws), np.int32, length.sum())
    n_docs = len(docs)
    del docs  # the words are many small objects
    buckets, owners = _subwords_of(list(index))
    pairs = np.unique(np.repeat(np.arange(n_docs), length) * len(index) + tokens) % len(index)
    often = np.bincount(buckets, np.bincount(pairs, minlength=len(index))[owners], BUCKETS) >= min(rarest, n_docs)
    n_sub = np.bincount(owners, minlength=len(index)).astype(float)
    buckets, owners = buckets[often[buckets]], owners[often[buckets]]
    del pairs
    there = np.zeros(BUCKETS, bool)
    there[buckets] = True
    used = np.flatnonzero(there)
    buckets = (np.cumsum(there) - 1).astype(np.int32)[buckets]
    at = np.concatenate([[0], np.cumsum(length)])
    width = np.minimum(RUN, length)
    runs = length - width + 1
    run_at = np.concatenate([[0], np.cumsum(runs)])
    run_doc = np.repeat(np.arange(n_docs, dtype=np.int32), runs)
    run_start = (np.arange(run_at[-1]) + (at[:-1] - run_at[:-1])[run_doc]).astype(np.int32)
    rng = np.random.default_rng(seed)
    e, u, b = rng.normal(0, 0.02, (len(used), dims)), rng.normal(0, 0.3, dims), -2.0
    cost = np.where(y > 0, (len(y) / 2) / max(1, y.sum()), (len(y) / 2) / max(1, (1 - y).sum())) ** 0.5
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (e, u, np.zeros(1))]
    top = np.zeros(n_docs)
    for step in range(1, epochs + 1):
        per_word = np.bincount(owners, (e @ u)[buckets], len(index)) / n_sub
        total = np.concatenate([[0.0], np.cumsum(per_word[tokens])])
        logits = (total[run_start + width[run_doc]] - total[run_start]) / width[run_doc]
        # a document's logit: the mean of its runs' at first, more and more that of the most toxic one
        sharp = 12.0 * max(0.0, step / epochs - 0.15)
        top = np.maximum.reduceat(logits, run_at[:-1])
        share = np.exp(sharp * (logits - top[run_doc]))
        share /= np.add.reduceat(share, run_at[:-1])[run_doc]
        z = np.add.reduceat(share * logits, run_at[:-1])
        gap = (1 / (1 + np.exp(-(z + b))) - y) * cost / n_docs
        on_run = (gap / width)[run_doc] * share
        on_token = np.cumsum(np.bincount(run_start, on_run, len(tokens) + 1) - np.bincount(run_start + width[run_doc], on_run, len(tokens) + 1))[:-1]
        on_word = np.bincount(tokens, on_token, len(index))
        on_sub = np.bincount(buckets, (on_word / n_sub)[owners], len(used))
        grads = [np.outer(on_sub, u) + decay * e, e.T @ on_sub, np.array([gap.sum()])]
        values = [e, u, np.array([b])]
        for x, g, (m, v) in zip(values, grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        b = float(values[2][0])
    scale, offset = _calibrate(top + b, y)
    full = np.zeros((BUCKETS, dims))
    full[used] = e
    return Model(full.astype(np.float32), u, b, scale, offset)


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and offset of a logistic fit, by Newton steps with a small ridge."""
    w = np.array([1.0, 0.0])
    x = np.stack([z, np.ones_like(z)], axis=1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-3]) * len(y)
        w = w - np.linalg.solve(h, x.T @ (p - y) + np.diag([1e-2, 1e-3]) @ (w - [1, 0]) * len(y))
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, holdout: tuple[int, int] | None = (5, 0), rows: int = 4000, max_bytes: int = 60_000) -> Model | None:
    """Fits on about `rows` labelled documents of max_bytes at most, chosen by a hash of the id, whose
    crc32(doc_id) modulo holdout[0] is not holdout[1]."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    if holdout:
        known = known.where(common.fold(holdout[0]) != holdout[1])
    n = known.count()
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(min(1.0, rows / max(1, n)) * (1 << 20))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.octet_length("text") <= max_bytes)
    got = sorted((r[0], r[1], r[2]) for r in texts.join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text").collect())
    return train([r[2] for r in got], np.array([r[1] != 0 for r in got])) if got else None


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row for each row of docs (doc_id, text): score."""
    shared = docs.sparkSession.sparkContext.broadcast(model.scorer() if model else None)

    def run(batches):
        scorer = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.score(texts) if scorer else list(repeat(0.0, len(texts))), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(common.released(run), "doc_id long, score double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = score_documents(docs, fit(docs, common.table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(common.fold(5) == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
