"""Nearest neighbours by randomly rotated one-bit codes.

Unit vectors are rotated at random; the sign of each coordinate is its code, packed into 64-bit words, and the
inner product of a vector with its own code is kept as a correction. A query is rotated as well and its
coordinates rounded to few bits; the bits' planes and a code give, by counting common bits, the inner product
of query and code, which divided by the correction estimates the cosine. A bound on its error follows from the
correction and the rounding. A query reranks the vectors whose estimate and bound reach the worst of its nearest
so far. Reranked scores are exact cosines of the original vectors.

Vectors lie in the order of coarse cells. For each query the k-th best cosine in a sample is known from the
start; a cell whose vectors, by the angle to its centre and its radius, can't reach that is skipped, which
never loses a neighbour.

Queries are sent to the executors in blocks of bounded size; each block passes over all vectors.

Vectors that are null, zero, or hold null or non-finite components, and rows without vec_id, take no part.
Vectors of different lengths aren't compared. Repeated rows count once. Of equal scores the smaller
vec_id comes first. Texts aren't read, however long. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


def rotation(dims: int, seed: int = 17) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed + dims).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


#: Bits of a query's coordinates.
PLANES = 6


def encode(rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs of rotated unit vectors, packed into words, and each vector's inner product with its unit code."""
    n, dims = rotated.shape
    packed = np.zeros((n, -(-dims // 64) * 8), np.uint8)
    packed[:, : -(-dims // 8)] = np.packbits(rotated > 0, axis=1)
    return packed.view(np.uint64), np.abs(rotated).sum(axis=1) / np.sqrt(dims)


def rounded(queries: np.ndarray, planes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rotated queries in `planes` bits: the bits' planes as words, and each query's least level, step and sum of levels."""
    n, dims = queries.shape
    low = queries.min(axis=1, keepdims=True)
    step = np.maximum(queries.max(axis=1, keepdims=True) - low, 1e-12) / ((1 << planes) - 1)
    levels = np.rint((queries - low) / step).astype(np.uint8)
    bits = np.zeros((planes, n, -(-dims // 64) * 8), np.uint8)
    for b in range(planes):
        bits[b, :, : -(-dims // 8)] = np.packbits(levels >> b & 1, axis=1)
    return bits.view(np.uint64), low[:, 0].astype(np.float32), step[:, 0].astype(np.float32), levels.sum(axis=1, dtype=np.float32)


def common_bits(codes: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """For each code (rows) and query (columns) the sum of the query's levels where the code has a bit."""
    shape = (len(codes), planes.shape[1])
    both, few, total = np.empty(shape, np.uint64), np.empty(shape, np.uint8), np.zeros(shape, np.uint32 if codes.shape[1] > 16 else np.uint16)
    part = np.empty_like(total)
    for b, plane in enumerate(planes):
        for w in range(codes.shape[1]):
            np.bitwise_and(codes[:, w, None], plane[None, :, w], out=both)
            np.bitwise_count(both, out=few)
            total += np.left_shift(few, b, out=part, dtype=part.dtype, casting="unsafe")
    return total


def estimates(codes: np.ndarray, correction: np.ndarray, queries: np.ndarray, planes: int = PLANES) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of vectors (rows) and rotated unit queries (columns), from counts of common bits, and the step of each query's rounding."""
    dims = queries.shape[1]
    bits, low, step, levels = rounded(queries, planes)
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.float32)
    signed = 2 * (ones[:, None] * low + common_bits(codes, bits) * step) - (low * dims + step * levels)
    return signed / (correction * np.sqrt(dims)).astype(np.float32)[:, None], step


def bounds(correction: np.ndarray, dims: int, confidence: float) -> np.ndarray:
    """The estimates' errors exceed this with a chance that falls as exp(-confidence**2 / 2)."""
    return np.sqrt(np.maximum(0, 1 / correction**2 - 1)) * confidence / np.sqrt(max(1, dims - 1))


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of columns, summed in order of the components: equal vectors have equal scores."""
    total = a[0] * b[0]
    for k in range(1, len(a)):
        total += a[k] * b[k]
    return total


class Exact:
    """Cosines of pairs of original vectors."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.norm = vectors, np.sqrt(_dots(vectors.T, vectors.T))

    def cosines(self, i: np.ndarray, other: Exact, j: np.ndarray, step: int = 50_000) -> np.ndarray:
        out = np.empty(len(i))
        for k in range(0, len(i), step):
            x, y = i[k : k + step], j[k : k + step]
            out[k : k + step] = _dots(self.vectors[x].T, other.vectors[y].T) / (self.norm[x] * other.norm[y])
        return out


class Best:
    """The k nearest vectors to each query so far."""

    def __init__(self, queries: int, k: int):
        self.k, self.score, self.id = k, np.full((queries, k), -np.inf), np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        some, k = np.unique(query), self.k
        q, i, s = np.concatenate([np.repeat(some, k), query]), np.concatenate([self.id[some].ravel(), ids]), np.concatenate([self.score[some].ravel(), score])
        order = np.lexsort((i, -s, q))
        first = order[np.searchsorted(q[order], some)[:, None] + np.arange(k)]
        self.id[some], self.score[some] = i[first], s[first]


class Cells:
    """Centres of coarse cells of unit vectors of one length, from a sample."""

    def __init__(self, sample: np.ndarray, most: int = 64, rounds: int = 8):
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.sample = sample
        self.centres = unit[np.linspace(0, len(unit) - 1, min(most, len(unit))).astype(int)]
        for _ in range(rounds):
            near = self.of(unit)
            total = np.zeros_like(self.centres)
            np.add.at(total, near, unit)
            norm = np.linalg.norm(total, axis=1, keepdims=True)
            self.centres = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), self.centres)

    def of(self, unit: np.ndarray) -> np.ndarray:
        return (unit @ self.centres.T).argmax(axis=1)


def _angles(unit: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ other.T, -1, 1))


class Block:
    """Queries of one length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, cells: Cells | None = None, known: np.ndarray | None = None, k: int = 5):
        self.ids, self.vectors, self.turn = ids, vectors, rotation(vectors.shape[1])
        self.unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        self.bits, self.low, self.width, self.levels = rounded(self.unit @ self.turn, 4)
        self.single, self.exactly = self.unit.astype(np.float32), Exact(vectors)
        self.centres = cells.centres if cells is not None else self.unit[:1]
        self.angle = _angles(self.unit, self.centres)
        #: The k-th best cosine among sampled vectors other than the query's own: a result has this at least.
        self.least = np.full(len(ids), -np.inf)
        if cells is not None and len(cells.sample) > k:
            sample = cells.sample / np.linalg.norm(cells.sample, axis=1, keepdims=True)
            for at in range(0, len(ids), 256):
                cos = self.unit[at : at + 256] @ sample.T
                cos[ids[at : at + 256, None] == known[None, :]] = -np.inf
                self.least[at : at + 256] = -np.partition(-cos, k - 1, axis=1)[:, k - 1] - 1e-9

    def search(self, ids: np.ndarray, vectors: np.ndarray, best: Best, confidence: float) -> None:
        """Adds the nearest of these vectors to best."""
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        near = _angles(unit, self.centres)
        cell = near.argmin(axis=1)
        for c in np.unique(cell):
            mine = np.flatnonzero(cell == c)
            reach = np.cos(np.maximum(0, self.angle[:, c] - near[mine, c].max()))  # no vector of the cell is nearer
            self._in_cell(np.flatnonzero(reach >= np.maximum(self.least, best.score[:, -1]) - 1e-9), ids[mine], vectors[mine], unit[mine], best, confidence)

    def _in_cell(self, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, unit: np.ndarray, best: Best, confidence: float, step: int = 128, rows: int = 512) -> None:
        """Tiles that stay in the processor's cache. Where few pairs of a tile pass their estimate these are scored at
        once; where many do, single-precision products come between."""
        codes, correction = encode(unit @ self.turn)
        root = np.sqrt(vectors.shape[1])
        scaled, ones = correction * root, np.bitwise_count(codes).sum(axis=1, dtype=np.float32)
        left = np.stack([scaled, -bounds(correction, vectors.shape[1], confidence) * scaled, np.ones(len(ids)), -ones], axis=1).astype(np.float32)
        single, exactly = unit.astype(np.float32), Exact(vectors)
        for at in range(0, len(queries), step):
            some = queries[at : at + step]
            bits, low, width, levels = self.bits[:, some], self.low[some], self.width[some], self.levels[some]
            rest = (low * vectors.shape[1] + width * levels - confidence * width * root / np.sqrt(12)) / (2 * width)
            for r in range(0, len(ids), rows):
                worst = np.maximum(self.least[some], best.score[some, -1]) - 1e-6
                # the least count with which estimate and bound reach the worst of the nearest so far
                enough = left[r : r + rows] @ np.stack([np.maximum(worst, -2) / (2 * width), 1 / (2 * width), rest, low / width]).astype(np.float32)
                passed = common_bits(codes[r : r + rows], bits) >= enough - np.float32(0.01)
                if np.count_nonzero(passed) > passed.size // 64:
                    passed &= single[r : r + rows] @ self.single[some].T >= (worst - 1e-5).astype(np.float32)
                i, j = np.divmod(np.flatnonzero(passed), len(some))
                other = ids[r + i] != self.ids[some[j]]
                i, j = r + i[other], some[j[other]]
                if len(i):
                    best.add(j, ids[i], exactly.cosines(i, self.exactly, j))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id long, embedding array<double>) of the rows that take part, each once."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(finite & F.exists("embedding", lambda x: x != 0)).dropDuplicates()


def _by_length(ids: np.ndarray, lists: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    size = np.diff(lists.offsets.to_numpy())
    flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()[:-1]
    return [(ids[rows], flat[at[rows][:, None] + np.arange(d)]) for d in np.unique(size) for rows in [np.flatnonzero(size == d)]]


def nearest(vectors: DataFrame, is_query, k: int = 5, confidence: float = 4.0, block: int = 16_384, sample: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where is_query holds, the k nearest other rows.

    block bounds the queries that are broadcast at once, sample the vectors that cells and first bounds are made from."""
    spark = vectors.sparkSession
    rows = common.staged(spark, usable(vectors), "vectors")
    total = rows.count()
    picked = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(min(1.0, sample / max(1, total)) * (1 << 20))).orderBy(F.xxhash64("vec_id")).limit(2 * sample).toArrow()
    known = {v.shape[1]: (i, v) for i, v in _by_length(picked["vec_id"].to_numpy(), picked["embedding"].combine_chunks())} if picked.num_rows else {}
    cells = {d: Cells(v) for d, (_, v) in known.items()}
    centres = spark.sparkContext.broadcast({d: c.centres for d, c in cells.items()})

    def place(batches):
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int32)
            lists = batch.column(1)
            size, flat, at = np.diff(lists.offsets.to_numpy()), lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()[:-1]
            for d in np.unique(size):
                if d in centres.value:
                    mine = np.flatnonzero(size == d)
                    v = flat[at[mine][:, None] + np.arange(d)]
                    cell[mine] = (v @ centres.value[d].T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["vec_id", "embedding", "cell"])

    rows = rows.mapInArrow(common.released(place), "vec_id long, embedding array<double>, cell int").repartitionByRange("cell", "vec_id").sortWithinPartitions("cell")
    rows = common.staged(spark, rows, "cells").select("vec_id", "embedding")
    queries = rows.where(is_query)
    n = -(-queries.count() // block)
    parts = []
    for b in range(n):
        some = queries if n == 1 else queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == b)
        got = some.toArrow()
        blocks = {v.shape[1]: Block(i, v, cells.get(v.shape[1]), known.get(v.shape[1], (None,))[0], k) for i, v in _by_length(got["vec_id"].to_numpy(), got["embedding"].combine_chunks())}
        shared = spark.sparkContext.broadcast(blocks)

        def run(batches, shared=shared):
            best = {d: Best(len(own.ids), k) for d, own in shared.value.items()}
            for batch in batches:
                for ids, v in _by_length(batch.column(0).to_numpy(), batch.column(1)):
                    if (own := shared.value.get(v.shape[1])) is not None:
                        own.search(ids, v, best[v.shape[1]], confidence)
            for d, own in shared.value.items():
                q, at = np.nonzero(best[d].score > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(own.ids[q]), pa.array(best[d].id[q, at]), pa.array(best[d].score[q, at])], ["query_id", "vec_id", "score"])

        found = rows.mapInArrow(common.released(run), "query_id long, vec_id long, score double")
        parts.append(found if n == 1 else common.staged(spark, found, "neighbours"))
    found = parts[0] if parts else spark.createDataFrame([], "query_id long, vec_id long, score double")
    for p in parts[1:]:
        found = found.union(p)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


#: For op3: exact search.
SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) AS s
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
ranked AS (
  SELECT query_id, vec_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS r FROM pairs)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, s AS score FROM ranked WHERE r <= 5
"""
