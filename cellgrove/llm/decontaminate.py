"""Benchmark decontamination by Wu-Manber multi-pattern search.

Windows of 13 consecutive words of benchmark items are the patterns (an item of fewer words is one
window). A text is reduced to its words, each between single spaces, so that a pattern with its
outer spaces can only match whole words. The searcher looks at a block of bytes that ends at a
position: a shift table says how far the next possible position is, a block that ends a pattern's
leading part selects a bucket of patterns, and each of these is compared directly. Patterns are
dealt into classes by length, so that short ones don't shorten the shifts of long ones.

The benchmark's text is sent to the executors in parts of bounded size, one at a time; they build the
tables, arrays of a few times the part's size. A text passes all parts; between two parts the rows
with their hits so far are written to the shared folder. Equal windows are told by hashes of 64 bits.

Null texts have no words. Items without id or words take no part; the same id in several rows is
one item. Documents without words are not contaminated. Very long texts are searched whole, in one
task. Windows met several times, in texts or items, count once. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Bytes that separate words, after lower-casing: all ASCII but digits, a-z (and what lies above 0x7F).
_SEPARATES = [b for b in range(128) if not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)]
_FOLD = bytes(0x20 if (low := b + 32 if 65 <= b <= 90 else b) in _SEPARATES else low for b in range(256))


def normal_words(text: bytes) -> list[bytes]:
    """The words of a text in UTF-8, A-Z lower-cased."""
    return text.translate(_FOLD).split()


def windows(words: list[bytes], size: int = 13) -> Iterator[bytes]:
    """Each window as a pattern: its words between single spaces, one at either end."""
    if words:
        for i in range(max(1, len(words) - size + 1)):
            yield b" " + b" ".join(words[i : i + size]) + b" "


def _block_hashes(buffer: bytes, begin: int, end: int, block: int, mask: int) -> np.ndarray:
    """The hash of the block at each place from begin to end."""
    return np.fromiter((crc32(buffer[i : i + block]) & mask for i in range(begin, end)), np.int64, end - begin)


class WuManber:
    """A searcher for patterns of similar length: the stretches of buffer from starts, in order, to ends. block: the length of the blocks looked at."""

    def __init__(self, buffer: bytes, starts: np.ndarray, ends: np.ndarray, block: int = 16):
        self.buffer, self.starts, self.ends = buffer, starts, ends
        self.reach = int((ends - starts).min())  # the leading part that shifts are made from
        self.block = max(1, min(block, self.reach // 3))
        self.skip = min(255, self.reach - self.block + 1)
        self.mask = (1 << min(25, max(12, (64 * len(starts)).bit_length()))) - 1
        table = np.full(self.mask + 1, self.skip, np.uint8)
        depth, places = self.reach - self.block, max(0, len(buffer) - self.block + 1)
        ending, key = starts + depth, np.zeros(len(starts), np.int64)
        for at in range(0, places, 1 << 20):
            place = np.arange(at, min(places, at + (1 << 20)))
            h = _block_hashes(buffer, at, int(place[-1]) + 1, self.block, self.mask)
            # of the patterns around a block the first one reaches on the least behind it
            first = np.searchsorted(starts, place - depth)
            first = starts[np.minimum(first, len(starts) - 1)]
            shift = depth - (place - first)
            ok = (first <= place) & (shift >= 0) & (shift < self.skip)
            np.minimum.at(table, h[ok], shift[ok].astype(np.uint8))
            i, j = np.searchsorted(ending, (at, at + len(place)))
            key[i:j] = h[ending[i:j] - at]
        self.table = table.tobytes()
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]

    @classmethod
    def of(cls, patterns: list[bytes], block: int = 16) -> WuManber:
        size = np.cumsum([0, *map(len, patterns)])
        return cls(b"".join(patterns), size[:-1], size[1:], block)

    def find(self, text: bytes) -> Iterator[tuple[int, int]]:
        """(start, number of the pattern) of every occurrence."""
        table, block, reach, mask = self.table, self.block, self.reach, self.mask
        end, n = reach, len(text)
        while end <= n:
            h = crc32(text[end - block : end]) & mask
            step = table[h]
            if step:
                end += step
                continue
            start = end - reach
            i, j = np.searchsorted(self.keys, (h, h + 1))
            for k in self.order[i:j].tolist():
                if text.startswith(self.buffer[self.starts[k] : self.ends[k]], start):
                    yield start, k
            end += 1


class Searcher:
    """All windows of one part of the benchmark: a WuManber for each class of lengths, and the items of each window."""

    def __init__(self, items: list[tuple[int, bytes]], size: int = 13):
        texts, owner, starts, ends, at = [], [], [], [], 0
        for item, text in items:
            words = normal_words(text)
            if not words:
                continue
            edge = np.cumsum([0, *(len(w) + 1 for w in words)]) + at  # the spaces
            n = max(1, len(words) - size + 1)
            starts.append(edge[:n])
            ends.append(edge[min(size, len(words)) :][:n] + 1)
            owner.append(np.full(n, item, np.int64))
            texts.append(b" " + b" ".join(words) + b" ")
            at += len(texts[-1])
        self.machines: list[tuple[WuManber, np.ndarray, np.ndarray]] = []
        if not texts:
            return
        buffer = b"".join(texts)
        starts, ends, owner = np.concatenate(starts), np.concatenate(ends), np.concatenate(owner)
        h = common.span_hashes(np.frombuffer(buffer, np.uint8), starts, ends)
        _, first, number = np.unique(h, return_index=True, return_inverse=True)
        first = np.sort(first)  # each distinct window where it comes first, by place
        rank = np.empty(len(first), np.int64)
        rank[number[first]] = np.arange(len(first))
        pair = np.unique(np.stack([rank[number], owner], axis=1), axis=0)
        at = np.searchsorted(pair[:, 0], np.arange(len(first) + 1))
        length = np.floor(np.log2(ends[first] - starts[first])).astype(np.int64)
        self.items, self.item_at = pair[:, 1].copy(), at
        for c in np.unique(length):
            mine = np.flatnonzero(length == c)
            self.machines.append((WuManber(buffer, starts[first[mine]], ends[first[mine]]), mine, (ends - starts)[first[mine]]))

    def hits(self, text: bytes) -> tuple[list[tuple[int, int]], set[int]]:
        """Ranges of hit words, and the items whose windows occur. text: words between single spaces."""
        found = [(start, int(size[k]), int(window[k])) for m, window, size in self.machines for start, k in m.find(text)]
        ranges, items, at, words = [], set(), 0, 0
        for start, size, window in sorted(found):
            words += text.count(b" ", at, start)
            at = start
            ranges.append((words, words + text.count(b" ", start, start + size) - 1))
            items.update(self.items[self.item_at[window] : self.item_at[window + 1]].tolist())
        return ranges, items


def covered(ranges: list[tuple[int, int]]) -> int:
    total, last = 0, 0
    for a, b in sorted(ranges):
        total += max(0, b - max(a, last))
        last = max(last, b)
    return total


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")


def benchmark_count(benchmark: DataFrame, part_bytes: int) -> int:
    """In how many parts the items are taken, so that each has about part_bytes at most."""
    return -(-(_items(benchmark).agg(F.sum(F.octet_length("text"))).first()[0] or 0) // part_bytes)


def benchmark_part(benchmark: DataFrame, k: int, n: int) -> list[tuple[int, bytes]]:
    """Part k of n of the items."""
    rows = _items(benchmark)
    if n > 1:
        rows = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
    return [(r[0], r[1].encode()) for r in rows.collect()]


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20, part_bytes: int = 4 << 20) -> DataFrame:
    """One row for each row of docs (doc_id, text); contaminated: share * hit words >= words, and any hit.

    part_bytes bounds the benchmark text of one part, and so what the driver holds and broadcasts at once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())

    def last(batch, rows):
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    return _through(rows, benchmark, size, share, part_bytes, last, SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20, part_bytes: int = 4 << 20) -> DataFrame:
    """The rows of docs, all columns, that aren't contaminated."""
    names = docs.columns

    def last(batch, rows):
        return batch.select(names).filter(pa.array([not r[-1] for r in rows]))

    return _through(docs, benchmark, size, share, part_bytes, last, docs.schema)


def _through(docs: DataFrame, benchmark: DataFrame, size: int, share: int, part_bytes: int, last, schema) -> DataFrame:
    """docs through all parts of the benchmark; hits so far travel along, and last(batch, results) makes the rows."""
    spark = docs.sparkSession
    held = common.unused("hit_ranges", docs), common.unused("hit_items", docs)
    carried = T.StructType([*docs.schema.fields, *(T.StructField(name, T.BinaryType()) for name in held)])
    at, state, n = docs.columns.index("text"), docs, benchmark_count(benchmark, part_bytes)
    for k in range(max(1, n)):
        part = spark.sparkContext.broadcast((uuid.uuid4().hex, benchmark_part(benchmark, k, n))) if n else None
        final = k >= n - 1
        state = state.mapInArrow(common.released(_pass(part, size, at, share, k == 0, last if final else None, held)), schema if final else carried)
        if not final:  # one part is on the executors at a time
            state = common.staged(spark, state, "decontaminated")
            part.destroy()
    return state


_BUILT: list = [None, None]


def _searcher(part, size: int) -> Searcher:
    """The searcher of a part; a worker keeps the last one for its next tasks."""
    name, items = part.value
    if _BUILT[0] != (name, size):
        _BUILT[:] = (name, size), Searcher(items, size)
    return _BUILT[1]


def _pass(part, size: int, at: int, share: int, first: bool, last, held: tuple[str, str]):
    def run(batches):
        machine = _searcher(part, size) if part is not None else None
        for batch in batches:
            out = []
            for k, text in enumerate(batch.column(at).cast(pa.binary()).to_pylist()):
                words = normal_words(text or b"")
                ranges, items = machine.hits(b" " + b" ".join(words) + b" ") if machine is not None and words else ([], set())
                if not first:
                    ranges += [tuple(x) for x in np.frombuffer(batch.column(held[0])[k].as_py(), np.int64).reshape(-1, 2).tolist()]
                    items |= set(np.frombuffer(batch.column(held[1])[k].as_py(), np.int64).tolist())
                if last is not None:
                    hit, ids = covered(ranges), ",".join(sorted(map(str, items)))
                    out.append((len(words), hit, len(items), hashlib.sha256(ids.encode()).hexdigest(), hit > 0 and share * hit >= len(words)))
                else:
                    out.append((np.array(ranges, np.int64).tobytes(), np.array(sorted(items), np.int64).tobytes()))
            if not out:
                continue
            if last is not None:
                yield last(batch, out)
            else:
                kept = [n for n in batch.schema.names if n not in held]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *(pa.array(c, pa.binary()) for c in zip(*out, strict=True))], [*kept, *held])

    return run


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: For op7: windows of each length in use joined with the items' windows.
SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
wins AS (SELECT DISTINCT item_id, len(p) AS n, array_to_string(p, ' ') AS p FROM
  (SELECT item_id, unnest(CASE WHEN len(w) > 13 THEN list_transform(range(1, len(w) - 11), lambda i: w[i:i + 12]) WHEN len(w) > 0 THEN [w] ELSE [] END) AS p FROM b)),
sizes AS (SELECT DISTINCT n FROM wins),
spots AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS p FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, s.n, item_id FROM spots s JOIN wins USING (n, p)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
