"""Language identification by nearest centroid.

Texts become normalised TF-IDF vectors of hashed character 1- to 3-grams. For each language several
centroids are found by spherical k-means, on the executors; a text gets the language of the centroid with the
largest cosine. Rejection goes by distance: a text is rejected if its cosine, or the lead of its language over
the next one, is below what passages of its length reach in texts that the centroids weren't fitted on.

Null texts and texts without a letter (Unicode category L) are `und`, score 0, rejected. Rows without lang are
not learned from; rows without doc_id count as held out. With nothing to learn from, all is `und`. Languages
with the same cosine go by name. Very long texts count whole, piece by piece. Repeated rows are learned from
each. Extra columns are not read.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DIMS = 4096
_ALNUM = re.compile(r"[^\W\d_]+")
_CHUNK = 1 << 20
#: Passages of about 2**k letters, k up to this, tell how near texts of a length come.
LENGTHS = 12


def has_letter(text: str) -> bool:
    """Whether a character of text is a letter; numbers such as one half aren't."""
    return any(m.group().isalpha() or any(map(str.isalpha, m.group())) for m in _ALNUM.finditer(text))


@functools.cache
def _letters() -> np.ndarray:
    """For each code point whether it is a letter or a mark on one."""
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)])


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed character 1- to 3-grams, a row for each text, and its number of letters. Digits count as 0, and a run of other characters that aren't letters as one space."""
    out, letters = np.zeros((len(texts), DIMS), np.float32), np.zeros(len(texts), np.int64)
    group, size = [], 0
    for i, text in enumerate(texts):
        if size and size + len(text) > _CHUNK:
            _count(texts, group, out, letters)
            group, size = [], 0
        group.append(i)
        size += len(text)
    if group:
        _count(texts, group, out, letters)
    return out, letters


def _count(texts: list[str], group: list[int], out: np.ndarray, letters: np.ndarray) -> None:
    lower = [texts[i].lower() for i in group]
    codes = np.frombuffer("".join(t + "\n" for t in lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(group), dtype=np.int64), np.array([len(t) + 1 for t in lower]))
    letter = (codes >= 97) & (codes <= 122)
    wide = np.flatnonzero(codes > 127)
    if len(wide):
        letter[wide] = _letters()[codes[wide]]
    letters[group] = np.bincount(row[letter], minlength=len(group))
    c = np.where(letter, codes, np.where((codes >= 48) & (codes <= 57), np.uint32(48), np.uint32(32)))
    keep = np.ones(len(c), bool)
    if len(c):
        keep[1:] = (c[1:] != 32) | (c[:-1] != 32) | (row[1:] != row[:-1])
    c, row = c[keep].astype(np.uint32), row[keep]
    h1 = c * np.uint32(2654435761)
    flat = np.zeros(len(group) * DIMS, np.int64)
    for n in (1, 2, 3):
        m = len(c) - n + 1
        if m <= 0:
            break
        h = h1[:m] ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
        for k in range(1, n):
            h = (h * np.uint32(0x9E3779B1)) ^ h1[k : k + m]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        same = row[:m] == row[n - 1 :] if n > 1 else slice(None)
        flat += np.bincount((row[:m] * DIMS + (h >> np.uint32(20)).astype(np.int64))[same], minlength=len(flat))
    out[group] = flat.reshape(len(group), DIMS)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Sublinear term frequencies times idf, each row of length 1 (or 0)."""
    x = np.log1p(counts) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def spherical_kmeans(x: np.ndarray, k: int, seed: int = 7, rounds: int = 20) -> np.ndarray:
    """Up to k unit centroids; start points are spread out by distance."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    while len(chosen) < min(k, len(x)):
        far = 1 - (x @ x[chosen].T).max(axis=1)
        far[chosen] = 0
        if far.max() <= 1e-6:
            break
        chosen.append(int(far.argmax()))
    centre = x[chosen]
    for _ in range(rounds):
        near = (x @ centre.T).argmax(axis=1)
        new = np.stack([x[near == j].sum(axis=0) if (near == j).any() else centre[j] for j in range(len(centre))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, centre, atol=1e-6):
            break
        centre = new
    return centre


def _bin(letters: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(letters, 1)).astype(np.int64), LENGTHS)


class Model:
    """floor, lead: for each centroid's language and each bin of lengths the least cosine and the least lead over other languages."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, langs: list[str], floor: np.ndarray, lead: np.ndarray):
        self.idf, self.centroids, self.langs, self.floor, self.lead = idf, centroids, langs, floor, lead
        self.number = np.unique(np.array(langs, object), return_inverse=True)[1] if langs else np.zeros(0, np.int64)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine to its nearest centroid (0 to 1), and whether that is too far."""
        langs, score, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        real = [i for i, t in enumerate(texts) if t and has_letter(t)]
        for k in range(0, len(real) if self.langs else 0, 256):
            some = real[k : k + 256]
            counts, letters = gram_counts([texts[i] for i in some])
            cos = weighted(counts, self.idf) @ self.centroids.T
            best = cos.argmax(axis=1)
            top, second = leads(cos, self.number, self.number[best])
            size = _bin(letters)
            score[some] = np.clip(top, 0, 1)
            rejected[some] = (top < self.floor[best, size]) | (top - second < self.lead[best, size])
            for i, j in zip(some, best.tolist(), strict=True):
                langs[i] = self.langs[j]
        return langs, score, rejected


def leads(cos: np.ndarray, number: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest cosine to a centroid of the text's own language, and to one of another (0 if there is none)."""
    mine = number[None, :] == own[:, None]
    return np.where(mine, cos, -1).max(axis=1), np.where(mine, 0, cos).max(axis=1)


def _passages(text: str, salt: int) -> list[str]:
    """Passages of one text, of about 2**k characters and more, at places that a hash chooses."""
    out = []
    for k in range(1, LENGTHS + 1):
        size = (1 << k) + (1 << k) // 3
        if len(text) < size:
            break
        out.append(text[(at := (salt >> k) * 0x9E3779B1 % (len(text) - size + 1)) : at + size])
    return out


def _sparse(counts: np.ndarray) -> bytes:
    at = np.flatnonzero(counts)
    return at.astype(np.uint16).tobytes() + counts[at].astype(np.float32).tobytes()


def _dense(rows: list[bytes]) -> np.ndarray:
    out = np.zeros((len(rows), DIMS), np.float32)
    for i, raw in enumerate(rows):
        n = len(raw) // 6
        out[i, np.frombuffer(raw, np.uint16, n)] = np.frombuffer(raw, np.float32, n, 2 * n)
    return out


def fit(docs: DataFrame, holdout: tuple[int, int] | None = (4, 2), per_lang: int = 400, centroids: int = 4, rare: float = 0.002, slack: float = 0.9, lead_share: float = 0.25) -> Model:
    """Fits on rows with a lang whose crc32(doc_id) modulo holdout[0] is not holdout[1].

    The idf is made from all of them; the centroids from about per_lang texts of each language, chosen
    by a hash of the id, each language in a task of its own. Floors come from passages of these texts, held
    against centroids of the other half of the texts: slack times the `rare` quantile of the cosines, and
    lead_share times that of the leads."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    if holdout:
        rows = rows.where(common.fold(holdout[0]) != holdout[1])
    n = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    empty = np.zeros((0, LENGTHS + 1), np.float32)
    if not n:
        return Model(np.zeros(DIMS, np.float32), np.zeros((0, DIMS), np.float32), [], empty, empty)
    share = F.create_map(*[F.lit(v) for lang, count in n.items() for v in (lang, min(1.0, per_lang / count))])
    chosen = rows.select("lang", "text", F.xxhash64("doc_id").alias("h"), (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * float(1 << 20)).alias("chosen"))
    names = ["lang", "h", "vector", "letters", "whole", "df"]

    def run(batches):
        df, seen = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            langs, texts, hashes, picked = (batch.column(k).to_pylist() for k in range(4))
            real = [i for i, t in enumerate(texts) if has_letter(t)]
            for k in range(0, len(real), 256):
                some = real[k : k + 256]
                counts, letters = gram_counts([texts[i] for i in some])
                df += (counts > 0).sum(axis=0)
                seen += len(some)
                out = [(langs[i], hashes[i], _sparse(counts[j]), int(letters[j]), True) for j, i in enumerate(some) if picked[i]]
                for i in some:
                    if picked[i] and (cut := _passages(texts[i], hashes[i] & (1 << 62) - 1)):
                        counts, letters = gram_counts(cut)
                        out += [(langs[i], hashes[i], _sparse(c), int(m), False) for c, m in zip(counts, letters, strict=True) if m]
                if out:
                    columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.bool_()), strict=True)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(out), pa.list_(pa.int64()))], names)
        nothing = [pa.nulls(1, t) for t in (pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.bool_())]
        yield pa.RecordBatch.from_arrays([*nothing, pa.array([[*df.tolist(), seen]], pa.list_(pa.int64()))], names)

    made = common.staged(rows.sparkSession, chosen.mapInArrow(common.released(run), "lang string, h long, vector binary, letters long, whole boolean, df array<long>"), "grams")
    df = np.zeros(DIMS + 1, np.int64)
    for at, count in made.select(F.posexplode("df").alias("at", "n")).groupBy("at").agg(F.sum("n")).collect():
        df[at] = count
    df, seen = df[:DIMS], int(df[DIMS])
    idf = (np.log((1 + seen) / (1 + df)) + 1).astype(np.float32)

    def centres(key, table):
        whole = sorted((h, v) for h, v, w in zip(*(table[c].to_pylist() for c in ("h", "vector", "whole")), strict=True) if w)
        x, half = weighted(_dense([v for _, v in whole]), idf), np.array([h >> 21 & 1 for h, _ in whole])
        parts = {"": spherical_kmeans(x, centroids)}
        for side in (0, 1):  # the half that passages of the other are held against
            parts[str(side)] = spherical_kmeans(x[half == side], centroids) if (half == side).any() else parts[""]
        rows = [(key[0].as_py(), name, c.astype(np.float32).tobytes()) for name, cs in parts.items() for c in cs]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.binary()), strict=True)], ["lang", "part", "centre"])

    vectors = made.where("lang IS NOT NULL").drop("df")
    fitted = sorted((r[0], r[1], bytes(r[2])) for r in vectors.groupBy("lang").applyInArrow(centres, "lang string, part string, centre binary").collect())
    of = lambda part: ([lang for lang, p, _ in fitted if p == part], np.stack([np.frombuffer(c, np.float32) for _, p, c in fitted if p == part]))
    if not fitted:
        return Model(idf, np.zeros((0, DIMS), np.float32), [], empty, empty)
    sides = [of("0"), of("1")]

    def floors(key, table):
        lang, rows = key[0].as_py(), []
        top, second, size = [], [], _bin(np.array(table["letters"].to_pylist()))
        h, v = table["h"].to_pylist(), table["vector"].to_pylist()
        for k in range(0, len(v), 512):
            x = weighted(_dense(v[k : k + 512]), idf)
            side = np.array([b >> 21 & 1 for b in h[k : k + 512]])
            a, b = np.zeros(len(x)), np.zeros(len(x))
            for s, (langs, c) in enumerate(sides):
                mine = np.array([name == lang for name in langs]).astype(np.int64)
                a[side != s], b[side != s] = leads(x[side != s] @ c.T, mine, np.ones(int((side != s).sum()), np.int64))
            top.append(a)
            second.append(b)
        top, second = np.concatenate(top), np.concatenate(second)
        floor = lead = 0.0
        for k in range(LENGTHS + 1):
            at = size == k
            if at.sum() >= 20:  # longer texts come no less near than shorter ones
                floor = max(floor, slack * float(np.quantile(top[at], rare)))
                lead = max(lead, lead_share * float(np.quantile((top - second)[at], rare)))
            rows.append((lang, k, floor, lead))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.float64(), pa.float64()), strict=True)], ["lang", "size", "floor", "lead"])

    langs, centre = of("")
    floor, lead = (np.zeros((len(langs), LENGTHS + 1)) for _ in range(2))
    for lang, k, a, b in vectors.groupBy("lang").applyInArrow(floors, "lang string, size long, floor double, lead double").collect():
        at = [i for i, name in enumerate(langs) if name == lang]
        floor[at, k], lead[at, k] = a, b
    return Model(idf, centre, langs, floor, lead)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each row of docs (doc_id, text): lang_pred, score, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            langs, score, rejected = shared.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(common.released(run), "doc_id long, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, whose text isn't rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            _, _, rejected = shared.value.predict(batch.column(at).to_pylist())
            yield batch.filter(pa.array(~rejected))

    return docs.mapInArrow(common.released(run), docs.schema)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = identify(docs, fit(docs))
    return out.select("doc_id", F.coalesce(common.fold(4) == 2, F.lit(True)).alias("held_out"), "lang_pred", "score", "rejected")
