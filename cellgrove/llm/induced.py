"""External induced sorting of suffixes, with the lengths of the prefixes that neighbours share.

Suffixes are L-type (larger than the next one) or S-type. The leftmost S-type ones are named by their
substrings, ordered by recursion on the names, at every level and over alphabets of any size, and all
others are induced from them in two sweeps. A sweep is a monotone priority queue: its tuples wait by
letter, in order of arrival, in one array that has a stretch for each letter; taking a batch from the
front of the least letter puts the left neighbours of its suffixes at the ends of later stretches, each
with its shared prefix, one more than the least one since the last entry of that stretch. Where letters
are many and rare, a batch is a range of letters: chains of left neighbours inside it are gathered and
ordered by doubling along the chains.

Arrays beyond `memory` bytes lie in unlinked scratch files of the task, as Spark's own spills do, and are
read and written in batches, so that memory is bounded whatever the length of the text; they end with
the task. Only `depth` letters are looked at: order beyond them is any.
"""

from __future__ import annotations

import tempfile

import numpy as np

_U = np.uint64


class Scratch:
    """Arrays in memory up to half of `memory` bytes in all, beyond that in unlinked files; batches take an eighth, so that they stay near the core."""

    def __init__(self, memory: int):
        self.left = memory // 2
        self.batch = max(1 << 12, memory // 2048)

    def array(self, n: int, dtype) -> np.ndarray:
        size = n * np.dtype(dtype).itemsize
        if size <= self.left:
            self.left -= size
            return np.zeros(n, dtype)
        with tempfile.TemporaryFile() as f:
            f.truncate(max(size, 1))
            return np.memmap(f, dtype, "r+", shape=(n,)) if n else np.zeros(0, dtype)

    def free(self, *arrays: np.ndarray | None) -> None:
        """Gives back the room of arrays that are no longer used."""
        self.left += sum(a.nbytes for a in arrays if a is not None and not isinstance(a, np.memmap))

    def places(self, n: int) -> np.ndarray:
        return self.array(n, np.int32 if n < 1 << 31 else np.int64)

    def batches(self, n: int):
        for i in range(0, n, self.batch):
            yield i, min(n, i + self.batch)

    def where(self, test, n: int) -> np.ndarray:
        """The places of range(n) where test(from, to) holds."""
        count = sum(int(np.count_nonzero(test(i, j))) for i, j in self.batches(n))
        out, at = self.array(count, np.int32 if n < 1 << 31 else np.int64), 0
        for i, j in self.batches(n):
            found = np.flatnonzero(test(i, j)) + i
            out[at : at + len(found)] = found
            at += len(found)
        return out

    def counts(self, values, n: int, letters: int) -> np.ndarray:
        """How often each letter comes among values(from, to)."""
        out = self.array(letters, np.int64)
        for i, j in self.batches(n):
            part = values(i, j)
            if letters <= self.batch:
                out += np.bincount(part, minlength=letters)
            else:
                letter, count = np.unique(part, return_counts=True)
                out[letter] += count
        return out


def _grouped(letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters in order, and where each was; equal letters stay in order."""
    key = np.sort(letter.astype(np.int64) << 32 | np.arange(len(letter)))
    return key >> 32, key & 0xFFFFFFFF


def kinds(text: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Twice each letter, and 1 more where the suffix is L-type. The last is S-type."""
    n = len(text)
    out = scratch.array(n, text.dtype)
    after = np.int8(-1)
    for i, j in reversed(list(scratch.batches(n))):
        less = np.empty(j - i, np.int8)
        part = text[i : min(n, j + 1)].astype(np.int64)
        step = np.sign(part[:-1] - part[1:])
        less[: len(step)] = step
        if j == n:
            less[-1] = -1
        at = np.where(less != 0, np.arange(j - i), j - i)
        at = np.minimum.accumulate(at[::-1])[::-1]
        full = np.append(less, after)[at]
        out[i:j] = part[: j - i] * 2 + (full > 0)
        after = full[0]
    return out


def _starts(counts: np.ndarray, scratch: Scratch) -> np.ndarray:
    out = scratch.array(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


class _Sweep:
    """One sweep: all suffixes of type `want`, in order, from `seeds`, the suffixes of the other type in order.

    back: letters and order run from large to small. shared: what each seed shares with the one taken
    before it (of any type; 0 for a letter's first), or None. seam(c, last) tells it for a letter's first seed."""

    def __init__(self, kind, want: int, back: bool, letters: int, seeds, shared, depth: int, scratch: Scratch):
        self.kind, self.want, self.depth, self.scratch = kind, want, depth, scratch
        self.back, self.letters, self.seeds, self.shared = back, letters, seeds, shared
        n = len(kind)
        count = scratch.counts(lambda i, j: self.flip((x := kind[i:j])[x & 1 == want] >> 1), n, letters)
        self.start, self.end = _starts(count, scratch), scratch.array(letters, np.int64)
        self.end[:] = self.start[:-1]
        seed_count = scratch.counts(lambda i, j: self.letter(seeds[i:j]), len(seeds), letters)
        self.seed = _starts(seed_count, scratch)
        self.out = scratch.array(int(self.start[-1]), np.int32 if n < 1 << 31 else np.int64)
        self.out_shared = scratch.array(len(self.out), np.uint16) if shared is not None else None
        self.since = np.full(letters, -1, np.int64) if shared is not None else None
        scratch.free(count, seed_count)

    def flip(self, letter: np.ndarray) -> np.ndarray:
        return (self.letters - 1) - letter.astype(np.int64) if self.back else letter

    def letter(self, places: np.ndarray) -> np.ndarray:
        return self.flip(self.kind[places] >> 1)

    def neighbours(self, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which suffixes have a left neighbour of the wanted type, the neighbours, and their letters."""
        left = suffix - 1
        letter = self.kind[left]  # that of the first suffix's neighbour is any
        at = np.flatnonzero((letter & 1 == self.want) & (left >= 0))
        return at, left[at], self.flip(letter[at] >> 1)

    def run(self, first: int | None, seam) -> tuple[np.ndarray, np.ndarray | None]:
        if first is not None:
            c = int(self.letter(np.array([first]))[0])
            self.out[self.end[c]] = first
            self.end[c] += 1
        scratch = self.scratch
        if self.shared is not None or self.letters <= 512:
            for c in np.flatnonzero(self.total(0, self.letters)).tolist():
                self.one(c, seam)
        else:
            done = 0
            while done < self.letters:
                # letters are taken together while they come to one batch
                ahead = np.cumsum(self.total(done, min(self.letters, done + scratch.batch)))
                stop = done + max(1, int(np.searchsorted(ahead, scratch.batch, "right")))
                if stop > done + 1:
                    self.many(done, stop)
                elif ahead[0]:
                    self.one(done, seam)
                done = stop
        scratch.free(self.start, self.end, self.seed)
        return self.out, self.out_shared

    def total(self, a: int, b: int) -> np.ndarray:
        """Suffixes of both types that are taken under each of the letters a to b."""
        return np.diff(self.start[a : b + 1]) + np.diff(self.seed[a : b + 1])

    def one(self, c: int, seam) -> None:
        i, step = int(self.start[c]), self.scratch.batch
        while i < self.end[c]:
            j = min(int(self.end[c]), i + step)
            self.deal(self.out[i:j], None if self.shared is None else self.out_shared[i:j].astype(np.int64))
            i = j
        x, y = int(self.seed[c]), int(self.seed[c + 1])
        for i in range(x, y, step):
            j = min(y, i + step)
            sh = None
            if self.shared is not None:
                sh = self.shared[i:j].astype(np.int64)
                if i == x:
                    last = int(self.end[c]) - 1
                    sh[0] = seam(c, int(self.out[last]), int(self.seeds[x])) if last >= self.start[c] else 0
            self.deal(np.array(self.seeds[i:j]), sh)

    def many(self, a: int, b: int) -> None:
        """The letters from a to b at once, without shared prefixes."""
        size = self.end[a:b] - self.start[a:b]
        begin = np.cumsum(size) - size
        there = np.arange(int(size.sum())) + np.repeat(self.start[a:b] - begin, size)
        arrived, seeds = self.out[there], self.seeds[int(self.seed[a]) : int(self.seed[b])]
        place = [arrived, seeds]
        cls = [np.zeros(len(arrived), np.int64), np.full(len(seeds), 2, np.int64)]
        parent = [np.zeros(len(arrived) + len(seeds), np.int64)]
        front, front_at, made = np.concatenate(place), np.arange(len(arrived) + len(seeds)), len(arrived) + len(seeds)
        while len(front):
            ok, left, letter = self.neighbours(front)
            ok, front = ok[letter < b], left[letter < b]
            parents = front_at[ok]
            if len(front):
                place.append(front)
                cls.append(np.ones(len(front), np.int64))
                parent.append(parents)
                front_at = np.arange(made, made + len(front))
                made += len(front)
        place, cls, parent = np.concatenate(place), np.concatenate(cls), np.concatenate(parent)
        key = (self.letter(place).astype(np.int64) - a) * 3 + cls
        grouped, order = _grouped(key)
        fresh = np.ones(made, bool)
        fresh[1:] = (grouped[1:] != grouped[:-1]) | (cls[order][1:] != 1)
        rank = np.empty(made, np.int64)
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(made), 0))
        jump = np.where(cls == 1, parent, np.arange(made))
        while not fresh.all():
            tied = ~fresh
            tied[:-1] |= ~fresh[1:]
            spot = np.flatnonzero(tied)
            some = order[spot]
            second = rank[jump[some]]
            by = np.argsort(rank[some] * made + second)
            some, second = some[by], second[by]
            first = rank[some]
            order[spot] = some
            new = np.ones(len(spot), bool)
            new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
            rank[some] = spot[np.maximum.accumulate(np.where(new, np.arange(len(spot)), 0))]
            fresh[spot] = new
            jump = jump[jump]
        place, cls = place[order], cls[order]
        self.out[int(self.start[a]) : int(self.start[b])] = place[cls < 2]
        self.end[a:b] = self.start[a + 1 : b + 1]
        self.deal(place, None, b)

    def deal(self, suffix: np.ndarray, shared: np.ndarray | None, least_letter: int = 0) -> None:
        """The left neighbours (of the wanted type) of a batch of suffixes, put at the ends of their stretches."""
        at, left, letter = self.neighbours(suffix)
        if least_letter:
            ok = letter >= least_letter
            at, left, letter = at[ok], left[ok], letter[ok]
        if not len(at):
            if shared is not None:
                np.minimum(self.since, shared.min(initial=self.depth), out=self.since)
            return
        letter, order = _grouped(letter)
        at, left = at[order], left[order]
        first = np.flatnonzero(np.concatenate([[True], letter[1:] != letter[:-1]]))
        count = np.diff(np.append(first, len(at)))
        heads = letter[first]
        to = np.repeat(self.end[heads] - first, count) + np.arange(len(at))
        self.out[to] = left
        self.end[heads] += count
        if shared is not None:
            begin = np.empty(len(at), np.int64)
            begin[1:] = at[:-1] + 1
            begin[first] = 0
            least = np.minimum.reduceat(np.append(shared, self.depth), np.stack([begin, at + 1], axis=1).ravel())[::2]
            least[first] = np.minimum(least[first], self.since[heads])
            tail = np.append(np.minimum.accumulate(shared[::-1])[::-1], self.depth)
            np.minimum(self.since, shared.min(), out=self.since)
            self.since[heads] = tail[at[first + count - 1] + 1]
            self.out_shared[to] = np.minimum(least + 1, self.depth)


def _direct(text: np.ndarray, a: int, b: int, cap: int) -> int:
    n = min(cap, len(text) - max(a, b))
    diff = np.flatnonzero(text[a : a + n] != text[b : b + n])
    return int(diff[0]) if len(diff) else n


def _induce(text, kind, lms, shared, letters: int, depth: int, scratch: Scratch) -> tuple:
    """L-type suffixes in order, S-type ones in reverse order, and shared prefixes, from the ordered leftmost S-type ones."""
    n, seams = len(text), {}
    large, large_shared = _Sweep(kind, 1, False, letters, lms, shared, depth, scratch).run(None, lambda c, a, b: _direct(text, a, b, depth))

    class Reversed:
        """What a suffix shares with the one after it in the order of the L-type ones."""

        def __getitem__(self, part: slice) -> np.ndarray:
            i, j = len(large) - part.stop, len(large) - part.start
            out = np.zeros(j - i, np.uint16)
            out[: j - i - (j == len(large))] = large_shared[i + 1 : j + 1]
            return out[::-1]

    def seam(c: int, a: int, b: int) -> int:
        seams[letters - 1 - c] = _direct(text, a, b, depth)
        return seams[letters - 1 - c]

    small, small_shared = _Sweep(kind, 0, True, letters, large[::-1], Reversed() if shared is not None else None, depth, scratch).run(n - 1, seam)
    return large, large_shared, small, small_shared, seams


def _merged(text, large, small, letters: int, scratch: Scratch) -> np.ndarray:
    """All suffixes in order: of each letter first L-type ones, then S-type ones."""
    n = len(text)
    small = small[::-1]
    smaller = _starts(scratch.counts(lambda i, j: text[small[i:j]], len(small), letters), scratch)
    larger = _starts(scratch.counts(lambda i, j: text[large[i:j]], len(large), letters), scratch)
    order = scratch.places(n)
    for i, j in scratch.batches(len(large)):
        part = np.array(large[i:j])
        order[np.arange(i, j) + smaller[text[part]]] = part
    for i, j in scratch.batches(len(small)):
        part = np.array(small[i:j])
        order[np.arange(i, j) + larger[text[part].astype(np.int64) + 1]] = part
    scratch.free(smaller, larger)
    return order


def _same(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the stretches of equal length at a and b are equal, by comparing letters."""
    same = np.ones(len(a), bool)
    live, k = np.arange(len(a)), 0
    while len(live):
        ok = text[a[live] + k] == text[b[live] + k]
        same[live[~ok]] = False
        k += 1
        live = live[ok & (length[live] > k)]
    return same


def order_suffixes(text: np.ndarray, letters: int, depth: int, scratch: Scratch, steps: int | None = None) -> np.ndarray:
    """Suffixes in order of their first `steps` letters (depth, if None) at least. The last letter is 0 and the only one."""
    steps = depth if steps is None else steps
    kind, lms, ranked = _sorted_lms(text, letters, steps, scratch)
    large, _, small, _, _ = _induce(text, kind, ranked, None, letters, depth, scratch)
    scratch.free(lms, ranked, kind)
    order = _merged(text, large, small, letters, scratch)
    scratch.free(large, small)
    return order


def _sorted_lms(text: np.ndarray, letters: int, steps: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Types, leftmost S-type suffixes by place, and the same in order of their first `steps` letters at least."""
    n = len(text)
    kind = kinds(text, scratch)

    def leftmost(i: int, j: int) -> np.ndarray:
        large = kind[max(0, i - 1) : j] & 1
        out = large[-(j - i) :] == 0
        out[1:] &= large[-(j - i) : -1] == 1
        out[0] &= i > 0 and large[0] == 1
        return out

    lms = scratch.where(leftmost, n)
    by_letter = scratch.array(len(lms), lms.dtype)
    at = _starts(scratch.counts(lambda i, j: text[lms[i:j]], len(lms), letters), scratch)
    for i, j in scratch.batches(len(lms)):
        part = lms[i:j]
        letter, order = _grouped(text[part])
        first = np.flatnonzero(np.concatenate([[True], letter[1:] != letter[:-1]]))
        count = np.diff(np.append(first, len(letter)))
        by_letter[np.repeat(at[letter[first]] - first, count) + np.arange(j - i)] = part[order]
        at[letter[first]] += count
    if len(lms) <= 1 or steps <= 1:
        return kind, lms, by_letter
    large, _, small, _, _ = _induce(text, kind, by_letter, None, letters, steps, scratch)
    scratch.free(large, at)
    # leftmost S-type ones among the S-type ones are in order of their substrings; by_letter takes them
    number = scratch.places(n)
    for i, j in scratch.batches(len(lms)):
        number[lms[i:j]] = np.arange(i + 1, j + 1)
    filled, small = 0, small[::-1]
    for i, j in scratch.batches(len(small)):
        part = number[small[i:j]]
        part = part[part > 0] - 1
        by_letter[filled : filled + len(part)] = part
        filled += len(part)
    scratch.free(number, small)
    names, top, before = scratch.array(len(lms), np.int32 if len(lms) < 1 << 31 else np.int64), -1, None
    for i, j in scratch.batches(len(lms)):
        part = np.array(by_letter[i:j])
        start = lms[part].astype(np.int64)
        length = np.where(part + 1 < len(lms), lms[np.minimum(part + 1, len(lms) - 1)] + 1, n) - start
        a, la = (start[:-1], length[:-1]) if before is None else (np.append(before[0], start[:-1]), np.append(before[1], length[:-1]))
        b, lb = (start[1:], length[1:]) if before is None else (start, length)
        new = np.ones(len(a), bool)
        cand = np.flatnonzero(la == lb)
        new[cand] = ~_same(text, a[cand], b[cand], la[cand])
        if before is None:
            new = np.concatenate([[True], new])
        name = top + np.cumsum(new)
        names[part] = name
        top, before = int(name[-1]), (start[-1], length[-1])
    if top + 1 < len(lms):
        # a substring has two letters at least that are its own, so half as many steps are left
        ranked = order_suffixes(names, top + 1, steps, scratch, -(-steps // 2))
    else:
        ranked = scratch.array(len(lms), by_letter.dtype)
        ranked[:] = by_letter
    scratch.free(names)
    for i, j in scratch.batches(len(lms)):
        by_letter[i:j] = lms[ranked[i:j]]
    scratch.free(ranked)
    return kind, lms, by_letter


class _Sums:
    """Hashes of stretches of a text from one running sum; powers come from two short tables."""

    BASE, STEP = 0x9E3779B97F4A7C15, 1 << 14

    def __init__(self, text: np.ndarray, letters: int, scratch: Scratch):
        n = len(text)
        low, high = np.full(self.STEP, self.BASE, _U), np.full(n // self.STEP + 2, pow(self.BASE, self.STEP, 2**64), _U)
        low[0] = high[0] = 1
        self.low, self.high = np.multiply.accumulate(low), np.multiply.accumulate(high)
        code = np.random.default_rng(letters).integers(1, 2**63, letters, dtype=_U) | _U(1)
        self.total, run = scratch.array(n + 1, _U), _U(0)
        for i, j in scratch.batches(n):
            part = np.cumsum(code[text[i:j]] * self.power(np.arange(i, j)), dtype=_U) + run
            self.total[i + 1 : j + 1] = part
            run = part[-1]

    def power(self, k: np.ndarray) -> np.ndarray:
        return self.low[k & (self.STEP - 1)] * self.high[k // self.STEP]

    def hashes(self, start: np.ndarray, length: int) -> np.ndarray:
        """The hash of a stretch, times the power of its start."""
        return self.total[start + length] - self.total[start]


def _shared(text: np.ndarray, order: np.ndarray, letters: int, cap: int, scratch: Scratch, least: int = 0) -> np.ndarray:
    """For each suffix in order the length, up to cap, of the prefix shared with the one before (0 for the first). Lengths below `least` may be 0."""
    sums, n = _Sums(text, letters, scratch), len(text)
    out = scratch.array(len(order), np.uint16)
    for i, j in scratch.batches(len(order)):
        part = order[max(0, i - 1) : j].astype(np.int64)
        a, b = np.minimum(part[:-1], part[1:]), np.maximum(part[:-1], part[1:])
        room, apart = np.minimum(cap, n - b), sums.power(b - a)
        got = np.zeros(len(a), np.int64)
        step, some = 1 << (cap.bit_length() - 1), np.arange(len(a))
        if least > 0:
            some = np.flatnonzero(room >= least)
            some = some[sums.hashes(a[some], least) * apart[some] == sums.hashes(b[some], least)]
            got[some], step = least, 1 << max(0, (cap - least).bit_length() - 1)
        while step:
            longer = some[got[some] + step <= room[some]]
            x = got[longer]
            same = sums.hashes(a[longer] + x, step) * apart[longer] == sums.hashes(b[longer] + x, step)
            got[longer[same]] += step
            step >>= 1
        out[max(i, 1) : j] = got
    scratch.free(sums.total)
    return out


def suffix_order(text: np.ndarray, letters: int, depth: int, scratch: Scratch, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first `depth` letters at least, and the prefixes shared with the one before, up to
    depth; of those shorter than `least` it is only known that they are. The last letter is 0 and the only one. The shared prefixes of the leftmost S-type ones are found by hashes
    of 64 bits, those of all others are induced."""
    if depth >= 1 << 16:
        raise ValueError("shared prefixes are kept in 16 bits")
    kind, lms, ranked = _sorted_lms(text, letters, depth, scratch)
    # an induced prefix is longer than the one that it comes from, by less than the longest stretch between two of these suffixes
    gap = max((int(np.diff(lms[max(0, i - 1) : j]).max(initial=0)) for i, j in scratch.batches(len(lms))), default=0)
    gap = max(gap, int(lms[0]) if len(lms) else len(text))
    scratch.free(lms)
    shared = _shared(text, ranked, letters, depth, scratch, max(0, least - gap - 1))
    large, large_shared, small, small_shared, seams = _induce(text, kind, ranked, shared, letters, depth, scratch)
    scratch.free(ranked, shared, kind)
    n = len(text)
    order, out = scratch.places(n), scratch.array(n, np.uint16)
    count_l = scratch.counts(lambda i, j: text[large[i:j]], len(large), letters)
    count_s = scratch.counts(lambda i, j: text[small[i:j]], len(small), letters)
    small, at, x, y = small[::-1], 0, 0, 0
    for c in range(letters):
        k, m = int(count_l[c]), int(count_s[c])
        order[at : at + k], out[at : at + k] = large[x : x + k], large_shared[x : x + k]
        at, x = at + k, x + k
        if m:
            order[at : at + m] = small[y : y + m]
            z = len(small) - y  # the letter's S-type suffixes are z - m to z of those in reverse order
            out[at] = seams.get(c, 0) if k else 0
            out[at + 1 : at + m] = small_shared[z - m + 1 : z][::-1]
            at, y = at + m, y + m
    scratch.free(large, large_shared, small, small_shared)
    return order, out
