"""Scores of texts under a Brown class-based bigram model.

Counts of all training words are made by a distributed count. Exchange clustering moves the most frequent
words, the core, between classes while the likelihood of class bigrams grows. Every other word that occurs
`least` times or more goes, in a distributed pass, to the class that makes its own neighbours likeliest.
Core and classes grow with the number of such words (up to a core that fits the driver), the words with a
class grow without bound. Rarer words form one more class, the end of a text another; the class bigrams
come from all training tokens. A token costs the transition from the class before it and its emission from
its own class, both smoothed; a text starts in the end class.

The vocabulary is sent to the executors in parts of bounded size, one at a time; where there are several, the
classes found so far travel along with the rows. Counts of rare words, however many, come by a join.

Words are told by hashes of 64 bits. Null texts are empty and hold just the end token. Rows without doc_id
count as held out. With no training rows all counts are 0 and V is 0; scores stay defined. Ties of counts
go by hash, of classes to the smaller number. Very long texts are scored whole, in one task. Repeated rows
are scored and counted each. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words with fewer training tokens share a class.
LEAST = 5
_BYTES = 2 << 20


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of rows with the hashes of their words, A-Z lower-cased, and where each row's words begin."""
    data, at = common.flat(column)
    for i, j in common.slices(at, _BYTES):
        low = common.LOWER[data[at[i] : at[j]]]
        starts, ends, first = common.words_of(low, at[i : j + 1] - at[i], common.SPACE)
        yield i, j, common.span_hashes(low, starts, ends).view(np.int64) if len(starts) else np.zeros(0, np.int64), first


def _batch(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def count_words(train: DataFrame) -> DataFrame:
    """(word long, n long) of all rows of train; word is a hash."""

    def run(batches):
        for batch in batches:
            for _, _, h, _ in _slices(batch.column(0)):
                yield _batch(["word", "n"], *np.unique(h, return_counts=True))

    return train.select("text").mapInArrow(common.released(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = 50) -> np.ndarray:
    """Class of each word from counts of word bigrams. The last two rows are words with classes of their own.

    Words start dealt out by frequency; each in turn goes to the class where the sum over class bigrams of
    n log n, less 2 n log n over classes, is largest, until a sweep moves none (or after `sweeps`)."""
    n = len(bigrams) - 2
    k = max(1, min(classes, n))
    of = np.concatenate([np.arange(n) % k, [k, k + 1]])
    size = k + 2
    member = np.zeros((len(of), size))
    member[np.arange(len(of)), of] = 1
    m = member.T @ bigrams @ member
    f = lambda x: x * np.log(np.maximum(x, 1.0))
    for _ in range(sweeps if k > 1 else 0):
        moved = 0
        for w in range(n):
            old, own = of[w], bigrams[w, w]
            left, right = np.bincount(of, bigrams[:, w], size), np.bincount(of, bigrams[w], size)
            left[old] -= own
            right[old] -= own
            if left.sum() + right.sum() + own == 0:
                continue
            m[:, old] -= left
            m[old] -= right
            m[old, old] -= own
            row, col = f(m[:k] + right) - f(m[:k]), f(m[:, :k].T + left) - f(m[:, :k].T)
            j = np.arange(k)
            d = m[j, j]
            gain = row.sum(axis=1) + col.sum(axis=1) - row[j, j] - col[j, j] + f(d + left[j] + right[j] + own) - f(d)
            rows, cols = m.sum(axis=1)[:k] + left[:k], m.sum(axis=0)[:k] + right[:k]
            gain -= f(rows + right.sum() + own) - f(rows) + f(cols + left.sum() + own) - f(cols)
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = int(old)
            m[:, new] += left
            m[new] += right
            m[new, new] += own
            moved += new != old
            of[w] = new
        if not moved:
            break
    return of


class Vocabulary:
    """Some words in order of their hashes, with their counts and classes."""

    def __init__(self, word: np.ndarray, n: np.ndarray, cls: np.ndarray):
        order = np.argsort(word)
        self.word, self.n, self.cls = word[order], n[order], cls[order].astype(np.int16)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Where each hash is, or -1."""
        if not len(self.word):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.word, h), len(self.word) - 1)
        return np.where(self.word[at] == h, at, -1)


def _followed(cls: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
    """The classes of several texts in one row, with the end before the first and after each text. first: where each text begins, and the last ends."""
    out = np.full(len(cls) + len(first), end, np.int64)
    texts = len(first) - 1
    out[np.arange(len(cls)) + 1 + np.repeat(np.arange(texts), np.diff(first))] = cls
    return out


def _pair_counts(train: DataFrame, width: int, classes) -> np.ndarray:
    """Counts of pairs of classes in sequence, from classes(batch): rows of classes."""

    def run(batches):
        seen = np.zeros(width * width, np.int64)
        for batch in batches:
            for row in classes(batch):
                pair, n = np.unique(row[:-1] * width + row[1:], return_counts=True)
                seen[pair] += n
        at = np.flatnonzero(seen)
        for i in range(0, len(at), 100_000):
            yield _batch(["at", "n"], at[i : i + 100_000], seen[at[i : i + 100_000]])

    out = np.zeros(width * width)
    pairs = train.mapInArrow(common.released(run), "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    for part in pairs.toArrow().to_batches():
        out[part.column(0).to_numpy()] = part.column(1).to_numpy()
    return out.reshape(width, width)


def _assigned(train: DataFrame, words: DataFrame, core: Vocabulary, m: np.ndarray) -> DataFrame:
    """(word, n, cls) of words (word, n): the class under which the core classes before and after them are likeliest.

    m: counts of class pairs of the core, with other words and ends as the last two classes."""
    k, size = len(m) - 2, len(m)
    shared = train.sparkSession.sparkContext.broadcast(core)
    smooth = m[:k] + 0.1
    into = np.log((m[:, :k] + 0.1) / (m.sum(axis=1, keepdims=True) + 0.1 * size))  # of a class after each class
    out_of = np.log(smooth / smooth.sum(axis=1, keepdims=True))
    cost = np.log(m[:, :k].sum(axis=0) + 1.0)  # of a token among those of its class

    def pairs(batches):
        for batch in batches:
            for _, _, h, first in _slices(batch.column(0)):
                at = shared.value.find(h)
                other = at < 0
                row = _followed(np.where(other, k, shared.value.cls[at] if len(shared.value.cls) else k), first, k + 1)
                place = np.arange(len(h)) + 1 + np.repeat(np.arange(len(first) - 1), np.diff(first))
                place = place[other]
                word, number = np.unique(h[other], return_inverse=True)
                key, n = np.unique(number * (size * size) + row[place - 1] * size + row[place + 1], return_counts=True)
                yield _batch(["word", "sides", "n"], word[key // (size * size)], key % (size * size), n)

    def best(batches):
        for batch in batches:
            lists, n = batch.column(2), batch.num_rows
            begin = lists.offsets.to_numpy()
            sides, count = lists.values.field(0).to_numpy(), lists.values.field(1).to_numpy()
            row = np.repeat(np.arange(n), np.diff(begin))
            left, right = np.zeros((n, size)), np.zeros((n, size))
            np.add.at(left, (row, sides // size), count)
            np.add.at(right, (row, sides % size), count)
            total = batch.column(1).to_numpy()
            score = left @ into + right @ out_of.T - total[:, None] * cost
            yield _batch(["word", "n", "cls"], batch.column(0).to_numpy(), total, score.argmax(axis=1).astype(np.int32))

    sides = train.select("text").mapInArrow(common.released(pairs), "word long, sides long, n long")
    per_side = sides.join(words.select("word", F.col("n").alias("total")), "word").groupBy("word", "total", "sides").agg(F.sum("n").alias("n"))
    per_word = per_side.groupBy("word", "total").agg(F.collect_list(F.struct("sides", "n")).alias("sides")).select("word", "total", "sides")
    return per_word.mapInArrow(common.released(best), "word long, n long, cls int")


class Model:
    """Totals, the table of words with a class (word, n, cls) in `parts` parts, and log probabilities of classes.

    m: counts of class pairs; its last two classes are rare words and the end."""

    def __init__(self, total: int, distinct: int, ends: int, vocabulary: DataFrame | None, parts: int, frequent: np.ndarray, n_frequent: int, m: np.ndarray):
        self.total, self.distinct, self.ends, self.vocabulary, self.parts = total, distinct, ends, vocabulary, parts
        self.rare, self.end = len(m) - 2, len(m) - 1
        prior = (m.sum(axis=0) + 0.1) / (m.sum() + 0.1 * len(m))
        self.log_next = np.log10((m + 0.5 * prior) / (m.sum(axis=1, keepdims=True) + 0.5))
        #: log10 of the tokens of each class, for the emission of its words.
        self.log_class = np.log10(np.maximum(frequent, 1.0))
        rare_total = max(0.0, total - ends - float(frequent.sum()))
        self.rare_norm = float(np.log10(rare_total + 0.1 * (max(0, distinct - n_frequent - (ends > 0)) + 1)))
        self.base_norm = float(np.log10(total + 0.1 * (distinct + 1)))
        self.end_log = float(np.log10(ends + 0.1))

    def part(self, k: int) -> Vocabulary:
        rows = self.vocabulary if self.parts == 1 else self.vocabulary.where(F.pmod(F.xxhash64("word"), F.lit(self.parts)) == k)
        got = rows.select("word", "n", "cls").toArrow()
        return Vocabulary(*(got[c].combine_chunks().to_numpy() if got.num_rows else np.zeros(0, np.int64) for c in ("word", "n", "cls")))


def _classified(rows: DataFrame, model: Model, finish, schema: str) -> DataFrame:
    """finish(batch, slices) for the batches of rows (doc_id, text) after all parts of the vocabulary.

    Of each slice it gets: the range of rows, hashes, where rows begin, the class of each word (-1: rare) and its count (0: rare)."""
    spark, state = rows.sparkSession, rows.select("doc_id", "text")
    parts = max(1, model.parts)
    for k in range(parts):
        shared = spark.sparkContext.broadcast(model.part(k)) if model.parts else None

        def run(batches, shared=shared, first=k == 0, last=k == parts - 1):
            for batch in batches:
                found, kept = [], []
                carried = None if first else [np.frombuffer(b"".join(batch.column(c).to_pylist()), t) for c, t in ((2, np.int16), (3, np.int64))]
                done = 0
                for i, j, h, begin in _slices(batch.column(1)):
                    cls, n = np.full(len(h), -1, np.int16), np.zeros(len(h), np.int64)
                    if carried:
                        cls[:], n[:] = (x[done : done + len(h)] for x in carried)
                        done += len(h)
                    if shared is not None:
                        at = shared.value.find(h)
                        hit = at >= 0
                        cls[hit], n[hit] = shared.value.cls[at[hit]], shared.value.n[at[hit]]
                    if last:
                        found.append((i, j, h, begin, cls, n))
                    else:
                        kept += [(cls[a:b].tobytes(), n[a:b].tobytes()) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
                if last:
                    yield from finish(batch, found)
                elif kept:
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.binary()) for c in zip(*kept, strict=True))], ["doc_id", "text", "cls", "n"])

        state = state.mapInArrow(common.released(run), schema if k == parts - 1 else "doc_id long, text string, cls binary, n binary")
        if k < parts - 1:
            state = common.staged(spark, state, "lm-classes")
            shared.destroy()
    return state


def fit(train: DataFrame, counts: DataFrame, least: int = LEAST, part_words: int = 2_000_000, core: tuple[int, int] = (512, 2048)) -> Model:
    """train: the training texts; counts: what count_words gave for them. core: bounds of the number of words that the
    driver clusters, one in fifty of those met `least` times otherwise; the classes are 1.5 times its square root."""
    spark = train.sparkSession
    ends = train.count()
    sums = counts.agg(F.sum("n"), F.count("*"), F.count_if(F.col("n") >= least)).first()
    total, distinct, frequent = int(sums[0] or 0) + ends, int(sums[1]) + (ends > 0), int(sums[2])
    size = min(max(core[0], min(core[1], frequent // 50)), frequent)
    if not size:
        m = np.zeros((2, 2))
        m[0, 1] = m[1, 0] = ends
        return Model(total, distinct, ends, None, 0, np.zeros(0), 0, m)
    got = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(size).toArrow()
    word, n = got["word"].combine_chunks().to_numpy(), got["n"].combine_chunks().to_numpy()
    ranked = Vocabulary(word, n, np.arange(size))
    shared = spark.sparkContext.broadcast(ranked)

    def ranks(batch):
        for _, _, h, first in _slices(batch.column(0)):
            at = shared.value.find(h)
            yield _followed(np.where(at < 0, size, shared.value.cls[at]), first, size + 1)

    bigrams = _pair_counts(train.select("text"), size + 2, ranks)
    classes = max(2, math.isqrt(9 * size // 4))
    of = exchange(bigrams, classes)
    k = int(of.max()) - 1
    member = np.zeros((len(of), k + 2))
    member[np.arange(len(of)), of] = 1
    table = spark.createDataFrame(list(zip(word.tolist(), n.tolist(), of[:size].tolist(), strict=True)), "word long, n long, cls int")
    rest = counts.where(F.col("n") >= least).join(F.broadcast(table.select("word")), "word", "left_anti")
    vocabulary = common.staged(spark, table.union(_assigned(train, rest, Vocabulary(word, n, of[:size]), member.T @ bigrams @ member)), "lm-vocabulary")
    per_class = np.zeros(k)
    for c, tokens in vocabulary.groupBy("cls").agg(F.sum("n")).collect():
        per_class[c] = tokens
    model = Model(total, distinct, ends, vocabulary, -(-frequent // part_words), per_class, frequent, np.ones((k + 2, k + 2)))

    def pairs(batch, found):
        seen = np.zeros((k + 2) ** 2, np.int64)
        for _, _, _, begin, cls, _ in found:
            row = _followed(np.where(cls < 0, k, cls), begin, k + 1)
            seen += np.bincount(row[:-1] * (k + 2) + row[1:], minlength=len(seen))
        at = np.flatnonzero(seen)
        yield _batch(["at", "n"], at, seen[at])

    m = np.zeros((k + 2) ** 2)
    for at, c in _classified(train, model, pairs, "at long, n long").groupBy("at").agg(F.sum("n")).collect():
        m[at] = c
    return Model(total, distinct, ends, vocabulary, model.parts, per_class, frequent, m.reshape(k + 2, k + 2))


_PART = "doc_id long, n_tokens long, head_known long, head_base double, head_score double, n_tail long, tail array<struct<word: bigint, n: bigint>>"


def score_documents(docs: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """One row for each row of docs (doc_id, text): n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    log_next, log_class, rare, end, end_log, ends = model.log_next, model.log_class, model.rare, model.end, model.end_log, model.ends
    tail_type = pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64())]))

    def finish(batch, found):
        for i, j, h, begin, cls, n in found:
            rows, per = j - i, np.diff(begin)
            row = np.repeat(np.arange(rows), per)
            known = cls >= 0
            base = np.log10(n + 0.1)
            emit = np.where(known, np.log10(np.maximum(n, 1)) - (log_class[cls] if len(log_class) else 0.0), 0.0)
            seq = _followed(np.where(known, cls, rare), begin, end)
            step = np.concatenate([[0.0], np.cumsum(log_next[seq[:-1], seq[1:]])])
            edge = begin + np.arange(rows + 1)  # of each text's steps
            sums = lambda v, row=row, rows=rows: np.bincount(row, v, rows)
            pair, tf = np.unique(np.stack([row[~known], h[~known]], axis=1), axis=0, return_counts=True) if (~known).any() else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
            at = np.searchsorted(pair[:, 0], np.arange(rows + 1))
            tail = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(pair[:, 1]), pa.array(tf)], ["word", "n"]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, rows),
                    *(pa.array(x) for x in (per + 1, sums(known).astype(np.int64) + (ends > 0), sums(np.where(known, base, 0.0)) + end_log, step[edge[1:]] - step[edge[:-1]] + sums(emit), sums(~known).astype(np.int64))),
                    tail.cast(tail_type),
                ],
                ["doc_id", "n_tokens", "head_known", "head_base", "head_score", "n_tail", "tail"],
            )

    parts = common.staged(spark, _classified(_rows(docs), model, finish, _PART).withColumn("rid", F.monotonically_increasing_id()), "lm-parts")
    tail = parts.select("rid", F.explode("tail").alias("t")).select("rid", F.col("t.word").alias("word"), F.col("t.n").alias("tf"))
    c = F.coalesce(F.col("n"), F.lit(0))
    per_doc = tail.join(counts, "word", "left").groupBy("rid").agg(F.sum(F.col("tf") * F.log10(c + 0.1)).alias("tail_log"), F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("tail_known"))
    log = F.coalesce(F.col("tail_log"), F.lit(0.0))
    return parts.drop("tail").join(per_doc, "rid", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("head_known") + F.coalesce(F.col("tail_known"), F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("head_base") + log - F.col("n_tokens") * F.lit(model.base_norm)).alias("base_score"),
        (F.col("head_score") + log - F.col("n_tail") * F.lit(model.rare_norm)).alias("score"),
    )


def op9_classlm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _rows(common.table(spark, sf_dir, "documents"))
    train = docs.where(common.fold(10) != 0)
    counts = common.staged(spark, count_words(train), "lm-counts")
    scored = score_documents(docs, counts, fit(train, counts))
    return scored.withColumn("held_out", F.coalesce(common.fold(10) == 0, F.lit(True))).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
