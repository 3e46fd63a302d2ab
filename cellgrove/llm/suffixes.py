"""Removal of repeated byte strings by external induced suffix sorting.

A byte is removed if a string of LENGTH bytes that covers it also starts elsewhere. Strings of REPORT bytes,
fewer, are looked for as well; bytes in those that start elsewhere are counted but stay.

Every window of REPORT bytes belongs to its anchor, a short string in it with the least hash; windows are
equal only if their anchors are, so the text around the anchors that occur more than once, dealt out by the
anchor's hash, holds all repeats. Pieces of equal content are one piece with a count. Where the pieces of one
anchor are too many for one task, their windows get longer anchors, and in the end are their own anchors, so
that no task depends on how often a string occurs among different surroundings.

Each shard of pieces is sorted by its suffixes, with the prefixes that neighbours share, as `induced` says, in
memory of bounded size. Neighbours in suffix order with LENGTH (or REPORT) common bytes are repeats.

Null and empty texts have no bytes, and nothing to remove. Repeated rows repeat each other's strings. Very
long texts are cut into runs of windows in blocks, without loss. Ties of hashes within a window go to the
first place. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .induced import Scratch, suffix_order

LENGTH = 400
REPORT = 280
ANCHOR = 48
_BLOCK = 1 << 20  # windows looked at together
_SLICE = 1 << 17  # bytes of texts or pieces looked at together, so that arrays stay in a core's cache


class Hashes:
    """Hashes of stretches of one text, from one running sum."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, self.down = common._powers(n + 1)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(common._BYTE[data] * up[:n], out=self.total[1:])

    def every(self, width: int) -> np.ndarray:
        """Of `width` bytes at each place, unmixed."""
        return (self.total[width:] - self.total[:-width]) * self.down[: len(self.total) - width]

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return common.mix64((self.total[end] - self.total[start]) * self.down[start])


def anchors(data: np.ndarray, length: int = REPORT, width: int = ANCHOR, hashes: Hashes | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows of `length` bytes of one text, in runs that share an anchor: first window, number of windows, anchor's place and hash.

    A window's anchor is the first of its `width`-byte strings with the least hash, so equal windows have
    anchors of equal hash at equal places. hashes: of data, or of a text that it begins."""
    n = len(data)
    if n < length:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64)
    h = (hashes or Hashes(data)).every(width)[: n - width + 1]
    index = _first_least(h, length - width + 1)  # of the anchor places in a window
    begin = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
    count = np.diff(np.concatenate([begin, [len(index)]]))
    return begin, count, index[begin], common.mix64(h[index[begin]])


def _first_least(h: np.ndarray, reach: int) -> np.ndarray:
    """For each window of `reach` entries the index of the first least one: least of a block's tail and the next block's head."""
    n = len(h)
    blocks = -(-n // reach)
    padded = np.full(blocks * reach, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = h
    grid = padded.reshape(blocks, reach)
    head = np.minimum.accumulate(grid, axis=1)
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1]
    place = np.arange(blocks * reach, dtype=np.int32).reshape(blocks, reach)
    new = np.ones_like(grid, bool)
    new[:, 1:] = grid[:, 1:] < head[:, :-1]
    head_at = np.maximum.accumulate(np.where(new, place, np.int32(0)), axis=1).ravel()
    back = np.ones_like(grid, bool)
    back[:, :-1] = grid[:, :-1] <= tail[:, 1:]
    tail_at = np.minimum.accumulate(np.where(back, place, np.int32(blocks * reach))[:, ::-1], axis=1)[:, ::-1].ravel()
    a, b = tail_at[: n - reach + 1], head_at[reach - 1 : n]
    return np.where(padded[b] < padded[a], b, a)


def repeated_starts(pieces: list[bytes], own: list[int], copies: list[int], length: int = LENGTH, report: int | None = None, memory: int = 128 << 20) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each piece, which of its first own[i] places start a string of `report` bytes, and of `length` bytes, that
    also starts elsewhere: in another place or another copy of the piece. Places beyond own[i] are left to other pieces."""
    shard = Shard(length, report or length, memory)
    for piece, k, c in zip(pieces, own, copies, strict=True):
        shard.add(piece, k, c)
    return list(shard.repeated())


class Shard:
    """Pieces to be sorted together; their bytes wait in an unlinked file."""

    def __init__(self, length: int = LENGTH, report: int = REPORT, memory: int = 128 << 20):
        self.length, self.report, self.scratch = length, report, Scratch(memory)
        self.file = tempfile.TemporaryFile()
        self.size: list[int] = []
        self.own: list[int] = []
        self.copies: list[int] = []

    def add(self, piece: bytes, own: int, copies: int) -> None:
        self.file.write(piece + b"\0")
        self.size.append(len(piece))
        self.own.append(own)
        self.copies.append(copies)

    def repeated(self):
        """For each piece in turn, which of its own places start repeats of `report` and of `length` bytes."""
        if not self.size:
            return
        at, n = np.cumsum([0, *(s + 1 for s in self.size)]), sum(self.size) + len(self.size) + 1
        scratch = self.scratch
        text, place = scratch.array(n, np.uint16), scratch.array(n, np.uint8)
        self.file.seek(0)
        for i, j in scratch.batches(n - 1):
            text[i:j] = np.frombuffer(self.file.read(j - i), np.uint8).astype(np.uint16) + 2
        self.file.close()
        text[at[1:] - 1] = 1
        # 1: owned and long enough for `report`, 2: for `length`
        for a, size, own in zip(at.tolist(), self.size, self.own, strict=False):
            place[a : a + max(0, min(own, size - self.report + 1))] = 1
            place[a : a + max(0, min(own, size - self.length + 1))] = 3
        order, shared = suffix_order(text, 258, self.length, scratch, self.report)
        again = scratch.array(n, np.uint8)
        last, least = -1, 0  # the owned place before, and the least shared prefix since
        for i, j in scratch.batches(n):
            mine = np.flatnonzero(place[order[i:j]])
            common_ = np.array(shared[i:j])
            if not len(mine):
                least = min(least, int(common_.min()))
                continue
            near = np.minimum.reduceat(common_[: mine[-1] + 1], np.concatenate([[0], mine[:-1] + 1]))
            near[0] = min(int(near[0]), least)
            own = order[i:j][mine]
            before = np.concatenate([[max(last, 0)], own[:-1]])
            if last < 0:
                near[0] = 0
            for bit, size in ((1, self.report), (2, self.length)):
                ok = (near >= size) & ((place[own] & bit) > 0) & ((place[before] & bit) > 0)
                again[own[ok]] |= bit
                again[before[ok]] |= bit
            last = int(own[-1])
            least = int(common_[mine[-1] + 1 :].min(initial=0xFFFF))
        for a, k, c in zip(at.tolist(), self.own, self.copies, strict=False):
            part = again[a : a + k] | (place[a : a + k] if c > 1 else 0)
            yield (part & 1) > 0, (part & 2) > 0


_RUNS = "tid long, ahash long, sid long, first int, windows int"


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty) and tid, a hash of the text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("tid", F.xxhash64("text"))


def _packed(texts: DataFrame) -> DataFrame:
    """texts as they are to be shuffled: doc_id, tid, bytes, and the text under zstd, about two thirds of what the shuffle's own codec leaves."""

    def run(batches):
        codec = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            raw = batch.column(2).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(map(len, raw)), pa.int64()), pa.array([codec.compress(r, asbytes=True) for r in raw], pa.binary())], ["doc_id", "tid", "size", "packed"])

    return texts.select("doc_id", "tid", "text").mapInArrow(common.released(run), "doc_id long, tid long, size long, packed binary")


def _unpacked(codec: pa.Codec, packed: bytes, size: int) -> bytes:
    return codec.decompress(packed, decompressed_size=size, asbytes=True) if size else b""


def _runs_in(data: np.ndarray, lo: int, hi: int, length: int, report: int, width: int):
    """Anchor's hash, piece's hash, first window and number of windows of each run among the windows lo to hi.

    A piece reaches from its first window's start to the end of a string of `length` bytes at its last, if the text does."""
    for a in range(lo, hi, _BLOCK):
        b = min(hi, a + _BLOCK)
        part = data[a : b + length - 1]
        hashes = Hashes(part)
        first, count, _, h = anchors(part[: b - a + report - 1], report, width, hashes)
        end = np.minimum(first + count + length - 1, len(part))
        sid = common.mix64(hashes.spans(first, end) + count.astype(np.uint64))
        yield h.view(np.int64), sid.view(np.int64), (first + a).astype(np.int32), count.astype(np.int32)


def _runs_of(data: np.ndarray, at: np.ndarray, length: int, report: int, width: int):
    """The row, and what _runs_in gives, of each run among all windows of the texts that lie one after the other in data, row r from at[r] to at[r + 1]."""
    size = np.diff(at)
    windows = np.maximum(0, size - report + 1)
    if not windows.any():
        return None
    hashes = Hashes(data)
    h = hashes.every(width)
    row = np.repeat(np.arange(len(size)), windows)
    place = np.arange(len(row)) + np.repeat(at[:-1] - (np.cumsum(windows) - windows), windows)
    index = _first_least(h, report - width + 1)[place]
    begin = np.flatnonzero(np.concatenate([[True], (index[1:] != index[:-1]) | (row[1:] != row[:-1])]))
    count = np.diff(np.concatenate([begin, [len(index)]]))
    row, first, anchor = row[begin], place[begin], common.mix64(h[index[begin]])
    end = np.minimum(first + count + length - 1, at[row + 1])
    sid = common.mix64(hashes.spans(first, end) + count.astype(np.uint64))
    return row, anchor.view(np.int64), sid.view(np.int64), (first - at[row]).astype(np.int32), count.astype(np.int32)


def window_runs(texts: DataFrame, length: int = LENGTH, report: int = REPORT, width: int = ANCHOR) -> DataFrame:
    """A row for each run of windows of `report` bytes with the same anchor: tid, anchor's hash, piece's hash, first window, windows.

    texts: (tid, text), or (tid, packed, size, ranges) for some windows of each text only."""
    some, names = "ranges" in texts.columns, ["tid", "ahash", "sid", "first", "windows"]

    def out(tid, columns):
        return pa.RecordBatch.from_arrays([pa.array(tid), *map(pa.array, columns)], names)

    def run(batches):
        for batch in batches:
            tid = batch.column(0).to_numpy()
            data, at = common.flat(batch.column(1))
            for i, j in common.slices(at, _SLICE):
                if at[j] - at[i] > 4 * _BLOCK:  # a very long text, in blocks of windows
                    text = data[at[i] : at[j]]
                    for columns in _runs_in(text, 0, max(0, len(text) - report + 1), length, report, width):
                        yield out(np.full(len(columns[0]), tid[i]), columns)
                elif (got := _runs_of(data[at[i] : at[j]], at[i : j + 1] - at[i], length, report, width)) is not None:
                    yield out(tid[i + got[0]], got[1:])

    def run_some(batches):
        codec = pa.Codec("zstd")
        for batch in batches:
            for tid, packed, size, ranges in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                text = np.frombuffer(_unpacked(codec, packed, size), np.uint8)
                for r in ranges:
                    for columns in _runs_in(text, r["first"], r["first"] + r["windows"], length, report, width):
                        yield out(np.full(len(columns[0]), tid), columns)

    rows = texts.select("tid", "packed", "size", "ranges") if some else texts.where(F.octet_length("text") >= report).select("tid", "text")
    return rows.mapInArrow(common.released(run_some if some else run), _RUNS)


def _contents(texts: DataFrame, wanted: DataFrame, length: int, report: int) -> DataFrame:
    """The bytes of each wanted piece (tid, ahash, sid, first, windows, copies)."""
    per_text = wanted.groupBy("tid").agg(F.collect_list(F.struct("ahash", "sid", "first", "windows", "copies")).alias("pieces"))

    def run(batches):
        codec = pa.Codec("zstd")
        for batch in batches:
            for k in range(batch.num_rows):
                text, ps = _unpacked(codec, batch.column(0)[k].as_py(), batch.column(1)[k].as_py()), batch.column(2)[k].as_py()
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([p[c] for p in ps], t) for c, t in (("ahash", pa.int64()), ("sid", pa.int64()), ("windows", pa.int32()), ("copies", pa.int64()))), pa.array([text[p["first"] : p["first"] + p["windows"] + length - 1] for p in ps], pa.binary())],
                    ["ahash", "sid", "windows", "copies", "content"],
                )

    joined = _packed(texts.where(F.octet_length("text") >= report)).drop("doc_id").join(per_text, "tid").select("packed", "size", "pieces")
    return joined.mapInArrow(common.released(run), "ahash long, sid long, windows int, copies long, content binary")


_FOUND = "sid long, short binary, long binary"


def _meeting(pieces: list[bytes], windows: list[int], report: int, width: int) -> np.ndarray:
    """Which pieces may share a string of `report` bytes with another one of their anchor.

    Equal windows have their anchors at equal places, so at one side of it at least they share half of what is left of
    `report`; a piece is out if no other one has the same bytes at either side, or none of its windows reaches so far."""
    side, sides = -(-(report - width) // 2), np.zeros((2, len(pieces)), np.uint64)
    there = np.zeros((2, len(pieces)), bool)
    for i, j in common.slices(np.cumsum([0, *map(len, pieces)]), _SLICE):
        hashes, at = Hashes(np.frombuffer(b"".join(pieces[i:j]), np.uint8)), np.cumsum([0, *map(len, pieces[i : j - 1])])
        anchor = at + hashes.every(width)[at[:, None] + np.arange(report - width + 1)].argmin(axis=1)
        last = at + np.array(windows[i:j]) - 1 + report
        for k, (ok, a, b) in enumerate(((anchor - at >= side, anchor - side, anchor + width), (last - anchor - width >= side, anchor, anchor + width + side))):
            there[k, i:j] = ok
            sides[k, i:j] = hashes.spans(np.where(ok, a, at), np.where(ok, b, at))
    out = np.zeros(len(pieces), bool)
    for ok, h in zip(there, sides, strict=True):
        some = np.flatnonzero(ok)
        _, which, n = np.unique(h[some], return_inverse=True, return_counts=True)
        out[some] |= n[which] > 1
    return out


def _parts(pieces: list[bytes], windows: list[int], report: int, width: int, grain: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """From where to where each piece may share bytes, around its anchor, with another one of that anchor; at most `grain` bytes too far at a side.

    Equal windows have their anchors at equal places, so all that two pieces share in their windows lies in one stretch
    around these, which ends where they differ first at either side. What is beyond is in no repeat."""
    size = np.array(list(map(len, pieces)), np.int64)
    left, right = np.zeros((2, len(pieces)), np.int64)
    sides = [np.zeros((most // grain, len(pieces)), np.uint32) for most in (report - width, int(size.max(initial=0)))]  # equal hashes of different bytes only take more along
    for i, j in common.slices(np.cumsum([0, *size]), _SLICE):
        hashes, at = Hashes(np.frombuffer(b"".join(pieces[i:j]), np.uint8)), np.cumsum([0, *size[i : j - 1]])
        anchor = at + hashes.every(width)[at[:, None] + np.arange(report - width + 1)].argmin(axis=1)
        left[i:j], right[i:j] = anchor - at, at + size[i:j] - anchor - width
        for k in range(len(sides[0])):
            sides[0][k, i:j] = hashes.spans(np.maximum(anchor - (k + 1) * grain, at), anchor + width)
        for k in range(len(sides[1])):
            sides[1][k, i:j] = hashes.spans(anchor, np.minimum(anchor + width + (k + 1) * grain, at + size[i:j]))
    lo, hi = left.copy(), left + width
    for room, hashed, sign, end in ((left, sides[0], -1, lo), (right, sides[1], 1, hi)):
        far, live = np.zeros(len(pieces), np.int64), np.arange(len(pieces))
        for k, h in enumerate(hashed):
            live = live[room[live] >= (k + 1) * grain]
            order = np.argsort(h[live])
            same = np.diff(h[live[order]]) == 0
            with_other = np.zeros(len(live), bool)
            with_other[order[1:]] |= same
            with_other[order[:-1]] |= same
            live = live[with_other]
            far[live] = (k + 1) * grain
        end += sign * np.minimum(far + grain - 1, room)
    return lo, hi


def _sort_shards(contents: DataFrame, shards: int, length: int, report: int, memory: int, width: int) -> DataFrame:
    """(sid, short, long) of each piece: which of its windows repeat, and which start repeats of `length` bytes, packed.

    Pieces that meet no other one beside their anchor are not sorted, and of the others only what another one may share.
    All windows of a piece with copies repeat."""

    def run(batches):
        shard, pieces = Shard(length, report, memory), {}
        for batch in batches:
            for sid, windows, copies, content in zip(*(batch.column(c).to_pylist() for c in ("sid", "windows", "copies", "content")), strict=True):
                pieces[sid] = windows, copies, content  # copies of a text give a piece several times
        alone = [(sid, [np.arange(p[0]) <= len(p[2]) - size for size in (report, length)]) for sid, p in pieces.items() if p[1] > 1]
        sids, rows = list(pieces), list(pieces.values())
        some = np.flatnonzero(_meeting([r[2] for r in rows], [r[0] for r in rows], report, width))
        rows = [rows[i] for i in some.tolist()]
        lo, hi = _parts([r[2] for r in rows], [r[0] for r in rows], report, width)
        sorted_ = []
        for i, (windows, copies, content), a, b in zip(some.tolist(), rows, lo.tolist(), hi.tolist(), strict=True):
            if (own := min(windows, b - report + 1) - a) > 0:
                sorted_.append((sids[i], windows, copies, a, own))
                shard.add(content[a:b], own, 1)
        pieces.clear()
        rows.clear()

        def found():
            for (sid, windows, copies, a, own), again in zip(sorted_, shard.repeated(), strict=True):
                if copies == 1 and again[0].any():
                    whole = np.zeros((2, windows), bool)
                    whole[:, a : a + own] = again
                    yield sid, whole

        ids, bits = [], ([], [])
        for sid, again in itertools.chain(alone, found()):
            if again[0].any():
                ids.append(sid)
                for column, which in zip(bits, again, strict=True):
                    column.append(np.packbits(which).tobytes())
            if len(ids) >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, pa.binary()) for c in bits)], ["sid", "short", "long"])
                ids, bits = [], ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, pa.binary()) for c in bits)], ["sid", "short", "long"])

    return contents.repartition(shards, "ahash").mapInArrow(common.released(run), _FOUND)


def _repeated_runs(texts: DataFrame, length: int, report: int, widths: tuple[int, ...], shard_bytes: int, memory: int) -> DataFrame:
    """(tid, first, windows, short, long) of the runs with repeats; a null for bits means all windows that are long enough."""
    spark = texts.sparkSession
    levels, source = [], texts
    for width in widths:
        runs = common.staged(spark, window_runs(source, length, report, width), "runs")
        repeated = common.staged(spark, runs.groupBy("ahash").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
        # anchors of more than a thousandth of all runs are a thousand at most; their rows stay where they are
        often = common.staged(spark, repeated.where(F.col("n") > F.lit(runs.count() / 1000)).select("ahash"), "often")
        if often.isEmpty():
            again = runs.join(repeated.select("ahash"), "ahash", "left_semi")
        else:
            often = F.broadcast(often)
            again = runs.join(often, "ahash", "left_semi").union(runs.join(often, "ahash", "left_anti").join(repeated.select("ahash"), "ahash", "left_semi"))
        again = common.staged(spark, again.groupBy("tid", "ahash", "sid", "first", "windows").agg(F.count("*").alias("n")), "again")
        pieces = again.groupBy("ahash", "sid").agg(F.sum("n").alias("copies"), F.min(F.struct("tid", "first")).alias("place"), F.first("windows").alias("windows"))
        pieces = common.staged(spark, pieces.select("ahash", "sid", "copies", "place.tid", "place.first", "windows"), "pieces")
        if width >= report:  # windows are their own anchors: counts decide
            none = F.when(F.col("copies") == 1, F.lit(bytearray(1)))
            levels.append(again.join(pieces.select("sid", F.lit(None).cast("binary").alias("short"), none.alias("long")), "sid").select("tid", "first", "windows", "short", "long"))
            break
        anchor = pieces.groupBy("ahash").agg(F.count("*").alias("kinds"), F.sum(F.col("windows") + (length - 1)).alias("bytes"))
        hot = common.staged(spark, anchor.where((F.col("kinds") > 1) & (F.col("bytes") > shard_bytes)).select("ahash"), "hot")
        sized = pieces.join(anchor.where(F.col("bytes") <= shard_bytes).where("kinds > 1").select("ahash"), "ahash", "left_semi")
        size = anchor.where((F.col("kinds") > 1) & (F.col("bytes") <= shard_bytes)).agg(F.sum("bytes")).first()[0] or 0
        sorted_ = _sort_shards(_contents(texts, sized, length, report), max(1, -(-size // shard_bytes)), length, report, memory, width)
        single = pieces.join(anchor.where("kinds = 1").select("ahash"), "ahash", "left_semi").select("sid", F.lit(None).cast("binary").alias("short"), F.lit(None).cast("binary").alias("long"))
        found = common.staged(spark, sorted_.union(single), "repeats")
        levels.append(again.join(found, "sid").select("tid", "first", "windows", "short", "long"))
        if hot.isEmpty():
            break
        ranges = again.join(hot, "ahash", "left_semi").groupBy("tid").agg(F.collect_set(F.struct("first", "windows")).alias("ranges"))
        source = _packed(texts).join(ranges, "tid")
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return out


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long, kept binary"


def remove_repeats(docs: DataFrame, length: int = LENGTH, report: int = REPORT, widths: tuple[int, ...] = (ANCHOR, 160), shard_bytes: int = 2 << 20, memory: int = 128 << 20, with_bytes: bool = True) -> DataFrame:
    """One row for each row of docs (doc_id, text): bytes, removed bytes, maximal removed runs, SHA-256 of the rest, bytes
    covered by strings of `report` bytes that also start elsewhere, and the rest itself (null without with_bytes).

    widths: of the anchors, tried in turn where an anchor has more than shard_bytes of pieces; in the end the windows
    are their own anchors. shard_bytes: about how much is sorted together; memory: what a task's arrays take at most
    before they go to scratch files."""
    if report > length:
        raise ValueError("reported strings are shorter than removed ones")
    texts = _texts(docs)
    runs = _repeated_runs(texts, length, report, (*(w for w in widths if w < report), report), shard_bytes, memory)
    removed = runs.groupBy("tid").agg(F.collect_set(F.struct("first", "windows", "short", "long")).alias("runs"))

    def run(batches):
        codec = pa.Codec("zstd")
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                lists = part.column(3)
                at, runs = lists.offsets.to_numpy(), [lists.values.field(c) for c in range(4)]
                first, windows = (runs[c].to_numpy() for c in (0, 1))
                rows = []
                for k, (t, n) in enumerate(zip(part.column(1), part.column(2), strict=True)):
                    own = slice(at[k], at[k + 1])
                    rows.append(_kept(_unpacked(codec, t.as_py(), n.as_py()), first[own], windows[own], runs[2][own].to_pylist(), runs[3][own].to_pylist(), length, report))
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, pa.array([r[5] if with_bytes else None for r in rows], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated", "kept"])

    return _packed(texts).join(removed, "tid", "left").select("doc_id", "packed", "size", "runs").mapInArrow(common.released(run), SCHEMA)


def _covered(n: int, first: np.ndarray, windows: np.ndarray, bits: list[bytes | None], size: int) -> np.ndarray:
    """Which of n bytes are covered by strings of `size` bytes that start at the marked windows."""
    starts = np.zeros(n, bool)
    for a, k, b in zip(first.tolist(), windows.tolist(), bits, strict=True):
        starts[a : a + k] = True if b is None else np.unpackbits(np.frombuffer(b, np.uint8), count=k)
    starts[max(0, n - size + 1) :] = False
    so_far = np.cumsum(starts, dtype=np.int32)
    so_far[size:] -= so_far[:-size].copy()
    return so_far > 0


def _kept(text: bytes, first: np.ndarray, windows: np.ndarray, short: list, long: list, length: int, report: int) -> tuple[int, int, int, str, int, bytes]:
    if not len(first):
        return len(text), 0, 0, hashlib.sha256(text).hexdigest(), 0, text
    gone = _covered(len(text), first, windows, long, length)
    seen = int(np.count_nonzero(_covered(len(text), first, windows, short, report)))
    spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if spans else text
    return len(text), int(np.count_nonzero(gone)), spans, hashlib.sha256(kept).hexdigest(), seen, kept


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents"), with_bytes=False).drop("kept")
