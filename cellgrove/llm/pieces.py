"""SentencePiece encoding and decoding with samples drawn without replacement.

A text is a lattice of vocabulary pieces; a segmentation's probability is proportional to the product of
its pieces' weights, which fall with their rank in the vocabulary as a power (Zipf). `samples` distinct
segmentations are drawn by the Gumbel top-k rule: an A-star search over regions of the lattice, each with
its exact log mass as the bound and a perturbed value that is a Gumbel variable truncated by its parent's.
The region with the largest value gives the next sample and is split at the places where others can leave
it. Each sample has its log probability and an inclusion score: the chance that its perturbed value passes
the next one, which would be left out. Draws are made from a hash of the row's key, so a row's samples
don't depend on partitions or batches; rows without key use a hash of the text.

Pieces never reach from one unit (a run of spaces with what follows it) into the next, so the lattice of a
text is a chain of its units' lattices. A task builds the lattice of each distinct unit once, all new ones of
a batch at the same time in numpy, and keeps them for later batches; at a bound, those met most often stay.

Characters without a piece become byte pieces, as does U+2581 itself; decoding gives back every text
exactly. A null text has no samples and null for whether it is exact; the empty text has one, without pieces.
A text with fewer segmentations than samples gives them all, each with inclusion score 1. Ties of perturbed
values go to the region made first. Repeated rows get the same samples. A very long text is a batch of its
own, whole. Extra columns are not read.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_UNITS = re.compile(r" +[^ ]*|[^ ]+")
_U = np.uint64


class Vocabulary:
    """Pieces of a SentencePiece model with log weights, and a trie of them for numpy."""

    def __init__(self, model: bytes, power: float = 1.0, floor: float = 12.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = sp.get_piece_size()
        self.bytes_of = [b""] * self.size
        self.byte_id = np.zeros(256, np.int32)
        self.log_weight = np.full(self.size, -floor * power)
        pieces = []
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"piece {i} reaches across units")
                pieces.append((-sp.get_score(i), i, piece))
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
        for rank, (_, i, _) in enumerate(sorted(pieces)):
            self.log_weight[i] = -power * np.log(rank + 3.0)
        chars = sorted({c for _, _, p in pieces for c in p})
        self.char = np.full(0x110000, len(chars), np.int32)
        self.char[[ord(c) for c in chars]] = np.arange(len(chars))
        self.n_chars = len(chars) + 1
        children: dict[tuple[int, int], int] = {}
        self.piece_at = [-1]
        at_char = {c: k for k, c in enumerate(chars)}
        for _, i, piece in pieces:
            node = 0
            for c in piece:
                key = (node, at_char[c])
                if key not in children:
                    children[key] = len(self.piece_at)
                    self.piece_at.append(-1)
                node = children[key]
            self.piece_at[node] = i
        keys = np.array([n * self.n_chars + c for n, c in children], np.int64)
        self._fill(keys, np.array(list(children.values()), np.int64))
        self.piece_at = np.array(self.piece_at, np.int32)
        self.inner = np.zeros(len(self.piece_at), bool)  # nodes with a next one
        self.inner[[n for n, _ in children]] = True
        self.first = np.full(self.n_chars, -1, np.int32)
        self.first[[c for n, c in children if n == 0]] = [child for (n, _), child in children.items() if n == 0]

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        """A hash table with open addressing, at most a quarter full."""
        self.bits = max(4, (4 * len(keys) - 1).bit_length())
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot_next = np.full(1 << self.bits, -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.slot_key[slot[left]] < 0
            self.slot_key[slot[left[free]]] = keys[left[free]]  # of several the last one stays
            won = self.slot_key[slot[left]] == keys[left]
            self.slot_next[slot[left[won]]] = values[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The trie's next node, or -1."""
        key = node.astype(np.int64) * self.n_chars + char
        slot = self._slot(key)
        found = self.slot_key[slot]
        out = np.where(found == key, self.slot_next[slot], -1)
        miss = np.flatnonzero((found != key) & (found >= 0))
        while len(miss):
            slot[miss] = (slot[miss] + 1) & ((1 << self.bits) - 1)
            found = self.slot_key[slot[miss]]
            hit = found == key[miss]
            out[miss[hit]] = self.slot_next[slot[miss[hit]]]
            miss = miss[~hit & (found >= 0)]
        return out

    def spells(self, ids: np.ndarray, text: bytes) -> bool:
        """Whether decoding ids gives the text; compares bytes without building the text anew."""
        if not hasattr(self, "flat"):
            size = np.array(list(map(len, self.bytes_of)))
            self.flat, self.length = np.frombuffer(b"".join(self.bytes_of), np.uint8), size
            self.begin = np.cumsum(size) - size
        n = self.length[ids]
        total = int(n.sum())
        if total != len(text) + 1:
            return total == len(text) == 0
        made = self.flat[np.arange(total) + np.repeat(self.begin[ids] - (np.cumsum(n) - n), n)]
        return made[0] == 32 and bool((made[1:] == np.frombuffer(text, np.uint8)).all())

    def decode(self, ids) -> str:
        text = b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


class Lattices:
    """The lattices of many units: nodes are in order of their distance to the unit's end, edges in order of their nodes.

    A second copy of the nodes on each unit's best path leads to all segmentations but that one."""

    def __init__(self, units: list[str], v: Vocabulary):
        codes = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int32)
        size = np.fromiter(map(len, units), np.int64, len(units))
        start = np.concatenate([[0], np.cumsum(size)])
        n = len(codes)
        left = (np.repeat(start[1:], size) - np.arange(n)).astype(np.int32)
        char = v.char[np.where(codes == 32, ord(SPACE), np.where(codes == ord(SPACE), 0x10FFFF, codes))]
        frm, to, ids, nth = [], [], [], []
        met = np.zeros(n, np.int32)  # edges of each place so far
        node, at, depth = v.first[char], np.arange(n, dtype=np.int32), 1
        none = (node < 0) | (v.piece_at[np.maximum(node, 0)] < 0)
        frm.append(at[none])
        to.append(at[none] + 1)
        ids.append(np.where(codes[none] < 128, v.byte_id[np.minimum(codes[none], 255)], v.size + codes[none]))  # longer ones are resolved into bytes in the end
        nth.append(met[at[none]])
        met[at[none]] += 1
        while len(at):
            ok = node >= 0
            at, node = at[ok], node[ok]
            piece = v.piece_at[node]
            has = piece >= 0
            start_ = at[has]
            frm.append(start_)
            to.append(start_ + depth)
            ids.append(piece[has])
            nth.append(met[start_])
            met[start_] += 1
            more = v.inner[node] & (left[at] > depth)
            at, node = at[more], node[more]
            node = v.step(node, char[at + depth])
            depth += 1
        frm, to, ids = np.concatenate(frm), np.concatenate(to), np.concatenate(ids)
        short = np.uint16 if left.max(initial=0) < 1 << 16 else np.int32  # which numpy sorts by digits
        rank = np.argsort(left.astype(short), kind="stable").astype(np.int32)  # nodes from the units' ends
        own = np.repeat(np.arange(len(units), dtype=np.int32), size)[rank]
        node_of = np.empty(n, np.int32)
        node_of[rank] = np.arange(n, dtype=np.int32)
        d_of = left[rank]
        degree = met[rank]
        at = np.concatenate([[0], np.cumsum(degree)]).astype(np.int32)
        order = np.empty(len(frm), np.int32)
        order[at[node_of[frm]] + np.concatenate(nth)] = np.arange(len(frm), dtype=np.int32)
        frm, to, ids = frm[order], to[order], ids[order]
        e_from = np.repeat(np.arange(n, dtype=np.int32), degree)
        inside = to < frm + left[frm]
        e_to = np.where(inside, node_of[np.minimum(to, n - 1)], np.int32(-1))
        extra = ids >= v.size
        self.extra = bool(extra.any())
        weight = v.log_weight[np.where(extra, 0, ids)]
        if self.extra:
            c = ids[extra] - v.size
            many = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
            weight[extra] = v.log_weight[v.byte_id[10]] * many
        beta, best, best_edge = np.empty(n + 1), np.empty(n + 1), np.zeros(n, np.int32)
        beta[-1] = best[-1] = 0.0  # the end, as node -1
        level = np.searchsorted(d_of, np.arange(1, (d_of[-1] if n else 0) + 2))
        for a, b in zip(level[:-1].tolist(), level[1:].tolist(), strict=True):
            if a == b:
                continue
            x, y = at[a], at[b]
            s = at[a:b] - x
            seg = e_from[x:y] - a
            w = weight[x:y] + best[e_to[x:y]]
            top = np.maximum.reduceat(w, s)
            best[a:b] = top
            hit = np.flatnonzero(w == top[seg])[::-1]
            best_edge[a + seg[hit]] = x + hit
            w = weight[x:y] + beta[e_to[x:y]]
            top = np.maximum.reduceat(w, s)
            beta[a:b] = top + np.log(np.add.reduceat(np.exp(w - top[seg]), s))
        self.ids, self.to, self.at = ids, e_to, at
        self.log_p = np.minimum(weight + beta[e_to] - beta[e_from], 0.0)
        self.start = node_of[start[:-1]]
        # best paths
        cur, owner, steps = self.start.copy(), np.arange(len(units)), []
        while len(cur):
            e = best_edge[cur]
            steps.append((owner, e))
            nxt = e_to[e]
            owner, cur = owner[nxt >= 0], nxt[nxt >= 0]
        owner, edge, step = np.concatenate([o for o, _ in steps]), np.concatenate([e for _, e in steps]), np.concatenate([np.full(len(o), k) for k, (o, _) in enumerate(steps)])
        order = np.lexsort((step, owner))
        owner, edge = owner[order], edge[order]
        self.best_at = np.searchsorted(owner, np.arange(len(units) + 1))
        self.best_ids = ids[edge]
        self.owner = np.concatenate([own, owner.astype(np.int32)])  # the unit of each node and copy
        self.best_log = best[self.start] - beta[self.start]
        # the copies: one for each step of a best path, from the last step to the first
        last = self.best_at[1:] - 1
        frm_node = e_from[edge]
        width = at[frm_node + 1] - at[frm_node]
        c_at = np.concatenate([[0], np.cumsum(width)])
        row = np.repeat(np.arange(len(edge), dtype=np.int32), width)
        c_edge = (np.arange(c_at[-1]) - c_at[row] + at[frm_node][row]).astype(np.int32)
        chance = np.exp(self.log_p)
        p = chance[c_edge]
        on = c_edge == edge[row]
        rest = np.add.reduceat(np.where(on, 0.0, p), c_at[:-1]) if len(edge) else np.zeros(0)
        p_on = chance[edge]
        q = np.zeros(len(edge))
        back = last.copy()
        q[back] = rest[back]
        live = back > self.best_at[:-1]
        first = self.best_at[:-1][live]
        back = back[live] - 1
        while len(back):
            q[back] = rest[back] + p_on[back] * q[back + 1]
            go = back > first
            back, first = back[go] - 1, first[go]
        follows = np.zeros(len(edge))
        follows[:-1] = q[1:]
        follows[last] = 0.0
        p = np.where(on, p * follows[row], p)
        self.q = q[self.best_at[:-1]]  # the chance of another segmentation than the best
        self.copy_start = n + self.best_at[:-1]
        target = np.where(on, np.int32(n + 1) + row, e_to[c_edge])
        # one table of all nodes and copies for drawing edges
        edges = np.concatenate([np.arange(len(ids), dtype=np.int32), c_edge])
        self.target = np.concatenate([e_to, np.where(on & (e_to[c_edge] < 0), np.int32(-1), target)]).astype(np.int32)
        self.piece, self.log = ids[edges].astype(np.int32), self.log_p[edges]
        prob = np.concatenate([chance, p])
        degree_ = np.concatenate([degree, width])
        self.ends = np.concatenate([at[1:], len(ids) + c_at[1:]]).astype(np.int32)
        begin, live, k = self.ends - degree_, np.flatnonzero(degree_ > 1), 1
        while len(live):  # sums within each node, so that they don't depend on the others
            place = begin[live] + k
            prob[place] += prob[place - 1]
            k += 1
            live = live[degree_[live] > k]
        total = prob[self.ends - 1]
        self.share = np.minimum(prob / np.repeat(np.where(total > 0, total, 1), degree_), 1.0)
        self.share[self.ends - 1] = 1.0


class Grown:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self.room, self.n = np.zeros(1 << 10, dtype), 0

    def add(self, more: np.ndarray) -> None:
        end = self.n + len(more)
        if end > len(self.room):
            room = np.zeros(max(end, len(self.room) * 3 // 2), self.room.dtype)
            room[: self.n] = self.room[: self.n]
            self.room = room
        self.room[self.n : end] = more
        self.n = end

    def become(self, fewer: np.ndarray) -> None:
        """Other content, not longer; the room stays."""
        self.n = len(fewer)
        self.room[: self.n] = fewer


class Store:
    """The lattices of units met so far, in one table. Where a batch would take it beyond `most` units, those that most batches met stay, half of `most` at most.

    New units are taken about `chars` characters at a time, as building a lattice takes many times the room that it keeps."""

    FIELDS = {"start": np.int32, "copy_start": np.int32, "best_end": np.int32, "best_log": float, "q": float, "log_q": float, "best_ids": np.int32, "ends": np.int32, "target": np.int32, "piece": np.int32, "log": float, "share": float, "owner": np.int32, "met": np.int32}

    def __init__(self, v: Vocabulary, most: int = 100_000, chars: int = 1 << 15):
        self.v, self.most, self.chars = v, most, chars
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.extra = False
        self.grown = {name: Grown(dtype) for name, dtype in self.FIELDS.items()}
        for name in ("ends", "best_end"):
            self.grown[name].add(np.zeros(1, np.int32))
        self._show()

    def _show(self, hidden: bool = False) -> None:
        """The tables as they are now. Hidden while they grow, else those before would be kept as well."""
        for name, x in self.grown.items():
            setattr(self, name, None if hidden else x.room[: x.n])

    def _found(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out = np.fromiter(map(self.index.get, units, itertools.repeat(-1)), np.int64, len(units))
        return out, np.flatnonzero(out < 0)

    def places(self, units: list[str]) -> np.ndarray:
        """Where each of the distinct units is in the table."""
        out, new = self._found(units)
        if self.index and len(self.index) + len(new) > self.most:
            room = min(self.most // 2, self.most - len(units))
            if room > 0 and len(self.index) <= self.most:
                self._keep(room)
            else:  # a very long text; the room that it took goes too
                self.clear()
            out, new = self._found(units)
        if len(new):
            out[new] = np.arange(len(self.index), len(self.index) + len(new))
            names = list(map(units.__getitem__, new.tolist()))
            self._show(hidden=True)
            for a, b in common.slices(np.cumsum([0, *map(len, names)]), self.chars):
                self._add(names[a:b])
            self._show()
        self.met[out] += 1
        return out

    def _add(self, units: list[str]) -> None:
        lat, g = Lattices(units, self.v), self.grown
        nodes, edges, steps, base = g["ends"].n - 1, g["target"].n, g["best_ids"].n, len(self.index)
        g["start"].add(lat.start + nodes)
        g["copy_start"].add(lat.copy_start + nodes)
        g["best_end"].add(lat.best_at[1:] + steps)
        g["best_log"].add(lat.best_log)
        g["q"].add(lat.q)
        g["log_q"].add(np.log(np.maximum(lat.q, 1e-300)))
        g["best_ids"].add(lat.best_ids)
        g["ends"].add(lat.ends + edges)
        g["target"].add(np.where(lat.target < 0, -1, lat.target + nodes))
        g["piece"].add(lat.piece)
        g["log"].add(lat.log)
        g["share"].add(lat.share)
        g["owner"].add(lat.owner + base)
        g["met"].add(np.zeros(len(units), np.int32))
        self.extra |= lat.extra
        self.index.update(zip(units, range(base, base + len(units)), strict=True))

    def _keep(self, count: int) -> None:
        """Drops all units but the `count` that most batches met, at least two; what was met long ago counts half."""
        often = np.argsort(-self.met, kind="stable")[:count]
        stays = np.zeros(len(self.met), bool)
        stays[often[self.met[often] > 1]] = True
        node, degree, steps = stays[self.owner], np.diff(self.ends), np.diff(self.best_end)
        edge, number = np.repeat(node, degree), np.cumsum(node, dtype=np.int32) - np.int32(1)
        target = self.target[edge]
        become = {
            **{name: number[getattr(self, name)[stays]] for name in ("start", "copy_start")},
            **{name: getattr(self, name)[stays] for name in ("best_log", "q", "log_q")},
            **{name: getattr(self, name)[edge] for name in ("piece", "log", "share")},
            "best_ids": self.best_ids[np.repeat(stays, steps)],
            "best_end": np.concatenate([[0], np.cumsum(steps[stays])]),
            "ends": np.concatenate([[0], np.cumsum(degree[node])]),
            "target": np.where(target < 0, np.int32(-1), number[target]),
            "owner": (np.cumsum(stays, dtype=np.int32) - np.int32(1))[self.owner[node]],
            "met": self.met[stays] // 2,
        }
        for name, x in become.items():
            self.grown[name].become(x)
        self.index = dict(zip(itertools.compress(self.index, stays.tolist()), itertools.count(), strict=False))
        self._show()

    def best(self, unit: int) -> tuple[int, ...]:
        return tuple(self.best_ids[self.best_end[unit] : self.best_end[unit + 1]].tolist())

    def draw(self, units: np.ndarray, key: np.ndarray, other: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segmentations of these units; other: any but the best. Index of the unit, piece and log probability of each step, in order."""
        cur = (self.copy_start if other else self.start)[units]
        who, out, step = np.arange(len(units)), [], 0
        while len(cur):
            u = _uniform(key[who] + _U((step + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1))
            e = self.ends[cur].astype(np.int64)
            on = np.flatnonzero(self.share[e] <= u)
            while len(on):
                e[on] += 1
                on = on[self.share[e[on]] <= u[on]]
            out.append((who, self.piece[e], self.log[e]))
            cur = self.target[e]
            go = cur >= 0
            who, cur = who[go], cur[go]
            step += 1
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        who = np.concatenate([x[0] for x in out])
        order = np.argsort(who, kind="stable")
        return who[order], np.concatenate([x[1] for x in out])[order], np.concatenate([x[2] for x in out])[order]

    def draw_one(self, unit: int, key: int, other: bool) -> tuple[tuple[int, ...], float]:
        """What draw gives for one unit, and its log probability."""
        cur, out, log, step = int((self.copy_start if other else self.start)[unit]), [], 0.0, 0
        while cur >= 0:
            u = (_mix_int((key + (step + 1) * 0x632BE59BD9B4E019) & _ALL) >> 11) * 2.0**-53
            e = int(self.ends[cur])
            while self.share[e] <= u:
                e += 1
            out.append(int(self.piece[e]))
            log += float(self.log[e])
            cur = int(self.target[e])
            step += 1
        return tuple(out), log


_ALL = (1 << 64) - 1


def _mix_int(h: int) -> int:
    """common.mix64 for one number."""
    h ^= h >> 33
    h = h * 0xFF51AFD7ED558CCD & _ALL
    h ^= h >> 33
    h = h * 0xC4CEB9FE1A85EC53 & _ALL
    return h ^ h >> 33


def _uniform(key: np.ndarray) -> np.ndarray:
    return (common.mix64(key) >> _U(11)).astype(float) * 2.0**-53


def draw_units(lat: Store, units: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """An exact draw for each unit. key: one for each. Log probabilities, which draws aren't the best segmentation, their pieces, and where each one's begin."""
    odd = np.flatnonzero(_uniform(key) < lat.q[units])
    who, ids, log = lat.draw(units[odd], common.mix64(key[odd]), True)
    logs = lat.best_log[units]
    logs[odd] = np.bincount(who, log, len(odd))
    return logs, odd, ids, np.searchsorted(who, np.arange(len(odd) + 1))


def _cut(drawn: tuple, a: int, b: int) -> tuple:
    """The draws of units a to b."""
    logs, odd, ids, at = drawn
    x, y = np.searchsorted(odd, (a, b))
    return logs[a:b], odd[x:y] - a, ids[at[x] : at[y]], at[x : y + 1] - at[x]


class Sample:
    """One segmentation of a text: for each unit its log probability; which aren't the best, their pieces, and where each one's begin.

    excluded: at one place, the segmentations of the unit there that samples before have taken."""

    def __init__(self, units: np.ndarray, log: np.ndarray, odd: np.ndarray, ids: np.ndarray, at: np.ndarray, excluded: dict[int, list[tuple[int, ...]]]):
        self.units, self.log, self.odd, self.ids, self.at, self.excluded = units, log, odd, ids, at, excluded

    def unit_pieces(self, i: int, lat: Store) -> tuple[int, ...]:
        k = int(np.searchsorted(self.odd, i))
        if k < len(self.odd) and self.odd[k] == i:
            return tuple(self.ids[self.at[k] : self.at[k + 1]].tolist())
        return lat.best(int(self.units[i]))


def pieces_of(lat: Store, samples: list[Sample]) -> tuple[np.ndarray, np.ndarray]:
    """All pieces of the samples, and where each one's begin."""
    begin = np.cumsum([0, *(len(s.units) for s in samples)])
    units = np.concatenate([s.units for s in samples]) if samples else np.zeros(0, np.int64)
    odd = np.concatenate([s.odd + b for s, b in zip(samples, begin.tolist(), strict=False)]) if samples else units
    size = lat.best_end[units + 1] - lat.best_end[units]
    is_odd = np.zeros(len(units), bool)
    is_odd[odd] = True
    if len(odd):
        size[odd] = np.concatenate([np.diff(s.at) for s in samples])
    at = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    out = np.repeat(lat.best_end[units] - at[:-1], size) + np.arange(at[-1])
    plain = np.repeat(~is_odd, size)
    out[plain] = lat.best_ids[out[plain]]
    if len(odd):
        out[~plain] = np.concatenate([s.ids for s in samples])
    return out, at[begin]


def _gumbel(u: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(np.clip(u, 1e-300, 1 - 1e-16)))


class Search:
    """The search for samples of one text: what was taken so far, and the regions of segmentations that are left."""

    def __init__(self, first: Sample, key: int):
        self.units, self.key, self.made = first.units, key, 0
        value = -math.log(-math.log(min(max((_mix_int(key ^ 0xA5A5) >> 11) * 2.0**-53, 1e-300), 1 - 1e-16)))
        self.out = [(first, float(first.log.sum()), value)]
        self.regions: list[list] = []  # sample, first place, perturbed values of the regions that leave it there or later, the largest

    def taken(self, samples: int) -> list[tuple[Sample, float, float]] | None:
        """(sample, log probability, inclusion score) if no more are to come."""
        self.best = max(range(len(self.regions)), key=lambda r: self.regions[r][3], default=0)
        top = self.regions[self.best][3] if self.regions else -math.inf
        if top == -math.inf:
            return [(s, lp, 1.0) for s, lp, _ in self.out]
        if len(self.out) == samples:
            return [(s, lp, -math.expm1(-math.exp(min(700.0, lp - top)))) for s, lp, _ in self.out]
        return None

    def wants(self) -> tuple[np.ndarray, np.ndarray]:
        """Takes the region with the largest value; the units after the place where it leaves its sample, and keys for them."""
        s, begin, values, bound = self.regions[self.best]
        j = int(values.argmax())
        values[j] = -np.inf
        self.regions[self.best][3] = float(values.max())
        self.made += 1
        i = begin + j
        self.leaving = s, i, bound
        keys = _U(_mix_int((self.key + self.made * 0xD1342543DE82EF95) & _ALL)) + np.arange(i, len(self.units)).astype(np.uint64) * _U(0x2545F4914F6CDD1D)
        self.own_key = int(keys[0])
        return self.units[i + 1 :], keys[1:]

    def take(self, lat: Store, tail: tuple) -> Sample:
        """The next sample, from the draws of the units that were wanted."""
        s, i, bound = self.leaving
        tail_log, tail_odd, tail_ids, tail_at = tail
        known = [*s.excluded.get(i, []), s.unit_pieces(i, lat)]
        own, tries = int(self.units[i]), 0
        best_ids = lat.best(own)
        while True:  # an exact draw from what is left of the unit
            ids, log = lat.draw_one(own, _mix_int((self.own_key + tries * 0x9E3779B97F4A7C15) & _ALL), best_ids in known)
            if ids not in known:
                break
            tries += 1
        keep = int(np.searchsorted(s.odd, i))
        is_best = ids == best_ids
        mid = [] if is_best else [i]
        at = int(s.at[keep])
        odd = np.concatenate([s.odd[:keep], np.array(mid, np.int64), tail_odd + (i + 1)])
        all_ids = np.concatenate([s.ids[:at], np.array(ids if mid else (), np.int64), tail_ids])
        shift = at + (len(ids) if mid else 0)
        begins = np.concatenate([s.at[: keep + 1], tail_at + shift if mid else tail_at[1:] + shift])
        logs = np.concatenate([s.log[:i], [lat.best_log[own] if is_best else log], tail_log])
        new = Sample(self.units, logs, odd, all_ids, begins, {i: known})
        self.out.append((new, float(logs.sum()), bound))
        return new


def _split(lat: Store, new: list[tuple[Search, Sample, int, float]]) -> None:
    """The regions that leave each sample at a place or later, perturbed below a bound; all samples at once."""
    size = [len(s.units) - begin for _, s, begin, _ in new]
    at = np.cumsum([0, *size])
    units = np.concatenate([s.units[begin:] for _, s, begin, _ in new])
    mass, leave = np.empty(at[-1]), lat.log_q[units]
    odd_at, odd_log = [], []
    for k, (_, s, begin, _) in enumerate(new):
        a, b = int(at[k]), int(at[k + 1])
        total = np.cumsum(s.log)
        mass[a] = total[begin - 1] if begin else 0.0
        mass[a + 1 : b] = total[begin:-1]
        odd = s.odd[np.searchsorted(s.odd, begin) :]
        odd_at.append(odd + (a - begin))
        odd_log.append(s.log[odd])
    odd_at, odd_log = np.concatenate(odd_at), np.concatenate(odd_log)
    leave[odd_at] = np.log(np.maximum(-np.expm1(odd_log), 1e-300))
    for k, (_, s, begin, _) in enumerate(new):
        for i, known in s.excluded.items():
            gone = sum(math.exp(_log_of(lat, int(units[at[k] + i - begin]), p)) for p in known) + math.exp(s.log[i])
            leave[at[k] + i - begin] = math.log(1 - gone) if gone < 1 - 1e-12 else -np.inf
    leave[leave < -600] = -np.inf
    mass += leave
    seeds = np.array([_mix_int((x.key + (x.made + 1) * 0x9E3779B97F4A7C15) & _ALL) for x, *_ in new], np.uint64)
    place = np.arange(at[-1]) - np.repeat(at[:-1] - [begin for _, _, begin, _ in new], size)
    mass += _gumbel(_uniform(np.repeat(seeds, size) + place.astype(np.uint64)))
    values = -np.logaddexp(-np.repeat([bound for *_, bound in new], size), -mass)
    top = np.maximum.reduceat(values, at[:-1])
    for k, (x, s, begin, _) in enumerate(new):
        x.regions.append([s, begin, values[at[k] : at[k + 1]], float(top[k])])


def _log_of(lat: Store, unit: int, pieces: tuple[int, ...]) -> float:
    node, total = int(lat.start[unit]), 0.0
    for p in pieces:
        e = int(lat.ends[node])
        while lat.piece[e] != p:
            e += 1
        total += float(lat.log[e])
        node = int(lat.target[e])
    return total


def _resolved(v: Vocabulary, ids: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stand-ins for characters without a piece become bytes; begin: where the samples begin."""
    extra = np.flatnonzero(ids >= v.size)
    if not len(extra):
        return ids, begin
    raw = [chr(c).encode() for c in (ids[extra] - v.size).tolist()]
    size = np.ones(len(ids), np.int64)
    size[extra] = [len(r) for r in raw]
    out = np.repeat(ids, size)
    out[np.repeat(ids >= v.size, size)] = v.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
    return out, np.concatenate([[0], np.cumsum(size)])[begin]


def _units_of(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct units of a batch, each text's units as their numbers, and how many each text has."""
    plain = [t if t and "  " not in t and t[0] != " " and t[-1] != " " else None for t in texts]
    split = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
    size = pc.fill_null(pc.list_value_length(split), 0).to_numpy().astype(np.int64)
    coded = split.flatten().dictionary_encode()
    names = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), coded.dictionary, pa.scalar(" ", pa.large_string())).to_numpy(zero_copy_only=False).tolist()
    units = coded.indices.to_numpy().astype(np.int64)
    others = [i for i, t in enumerate(texts) if t and plain[i] is None]
    if others:
        index, rows = {u: i for i, u in enumerate(names)}, np.split(units, np.cumsum(size)[:-1])
        for i in others:
            rows[i] = np.array([index.setdefault(u, len(index)) for u in _UNITS.findall(" " + texts[i])], np.int64)
            size[i] = len(rows[i])
        names, units = list(index), np.concatenate(rows)
    return names, units, size


def encode_flat(store: Store, texts: list[str | None], keys: list[int], samples: int) -> tuple[np.ndarray, np.ndarray, list[float], list[float], list[int]]:
    """All samples of the texts: their pieces, where each sample's begin, log probabilities, inclusion scores, and samples of each text."""
    names, units, size = _units_of(texts)
    units = store.places(names)[units] if names else units
    at = np.concatenate([[0], np.cumsum(size)])
    seeds = np.array(keys, np.uint64)
    row = np.repeat(np.arange(len(texts)), size)
    place = (np.arange(len(units)) - at[row]).astype(np.uint64)
    done: list[list] = [[] if t is None else [(Sample(units[:0], np.zeros(0), units[:0], units[:0], np.zeros(1, np.int64), {}), 0.0, 1.0)] for t in texts]
    if names:
        whole = draw_units(store, units, common.mix64(common.mix64(seeds)[row] + place * _U(0x9E3779B97F4A7C15)))
        live = [(i, Search(Sample(units[at[i] : at[i + 1]], *_cut(whole, at[i], at[i + 1]), {}), keys[i])) for i in np.flatnonzero(size).tolist()]
        new = [(x, x.out[0][0], 0, x.out[0][2]) for _, x in live]
        while new:  # all texts that want another sample are drawn together
            _split(store, new)
            left = []
            for i, x in live:
                if (got := x.taken(samples)) is None:
                    left.append((i, x))
                else:
                    done[i] = got
            live = left
            wants = [x.wants() for _, x in live]
            ends = np.cumsum([len(u) for u, _ in wants]).tolist()
            drawn = draw_units(store, np.concatenate([u for u, _ in wants]), np.concatenate([k for _, k in wants])) if wants else None
            new = [(x, x.take(store, _cut(drawn, a, b)), x.leaving[1], x.leaving[2]) for (_, x), a, b in zip(live, [0, *ends], ends, strict=False)]
    flat = [s for row_ in done for s in row_]
    if names:
        ids, begin = pieces_of(store, [s for s, _, _ in flat])
        if store.extra:
            ids, begin = _resolved(store.v, ids, begin)
    else:
        ids, begin = np.zeros(0, np.int64), np.zeros(len(flat) + 1, np.int64)
    return ids, begin, [lp for _, lp, _ in flat], [inc for _, _, inc in flat], [len(x) for x in done]


def encode_batch(v: Vocabulary, texts: list[str | None], keys: list[int], samples: int) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text its samples: pieces, log probability, inclusion score."""
    ids, begin, logs, inclusion, count = encode_flat(Store(v), texts, keys, samples)
    flat = iter([(ids[a:b], lp, inc) for a, b, lp, inc in zip(begin[:-1].tolist(), begin[1:].tolist(), logs, inclusion, strict=True)])
    return [[next(flat) for _ in range(n)] for n in count]


SCHEMA = "doc_id long, ids array<array<int>>, log_probs array<double>, inclusion array<double>, exact boolean"


def sample_documents(docs: DataFrame, model: str = MODEL, samples: int = 3, seed: int = 0, power: float = 1.0, chars: int = 1 << 19, most: int = 100_000) -> DataFrame:
    """One row for each row of docs (doc_id, text): up to `samples` segmentations with log probabilities and
    inclusion scores, and whether each decodes to the text. model: a local path, read on the driver; chars: about
    how many characters are taken together; most: units whose lattices a task keeps. Samples depend on neither."""
    with open(model, "rb") as f:
        proto = f.read()
    if len(proto) > 64 << 20:
        raise ValueError("the model is too large to be sent to all executors")
    shared = docs.sparkSession.sparkContext.broadcast(proto)

    def run(batches):
        v = Vocabulary(shared.value, power)
        store = Store(v, most)
        for batch in batches:
            texts, keys = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j] or "") <= chars):
                    size += len(texts[j] or "")
                    j += 1
                ids, begin, logs, inclusion, count = encode_flat(store, texts[i:j], [k & (1 << 64) - 1 for k in keys[i:j]], samples)
                rows, k, exact = np.cumsum([0, *count]), 0, []
                for t, n in zip(texts[i:j], count, strict=True):
                    exact.append(None if t is None else all(v.spells(ids[begin[m] : begin[m + 1]], t.encode()) for m in range(k, k + n)))
                    k += n
                at = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(at, pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids.astype(np.int32)))), *(pa.ListArray.from_arrays(at, pa.array(x, pa.float64())) for x in (logs, inclusion)), pa.array(exact, pa.bool_())],
                    ["doc_id", "ids", "log_probs", "inclusion", "exact"],
                )
                i = j

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit(seed))).otherwise(F.xxhash64("doc_id", F.lit(seed)))
    return rows.select("doc_id", "text", key.alias("key")).mapInArrow(common.released(run), SCHEMA)


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_documents(common.table(spark, sf_dir, "documents"))
