import collections
import hashlib
import re

import numpy as np
import pytest

from cellgrove.llm import decontaminate, induced, neardup, suffixes


# near duplicates
def brute_groups(rows):
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def test_near_duplicates_against_brute_force(docs):
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(90):  # one group of edited copies around the threshold, and chains
        w = list(base)
        for k in rng.choice(60, rng.integers(0, 4), replace=False):
            w[k] = f"x{int(rng.integers(3))}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join(f"v{i}_{k}" for k in range(30))) for i in range(20)] + [(300, rows[5][1].upper()), (301, "one two three"), (302, "one  two\nthree"), (303, "one two"), (None, rows[7][1])]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs(*rows)).collect()), key=str)
    assert got == sorted(brute_groups(rows), key=str)


def test_near_duplicates_odd_rows(odd):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == 9
    for r in got:
        assert r.kept == (r.doc_id == r.component_id) and (r.n_shingles > 0 or r.component_id == r.doc_id)
    left = neardup.drop_near_duplicates(odd)
    assert left.columns == odd.columns and sorted((r.doc_id for r in left.collect()), key=str) == sorted([1, 2, None, 3, 4, 5, 6, None], key=str)
    assert neardup.near_duplicates(odd.where("false")).count() == 0 == neardup.drop_near_duplicates(odd.where("false")).count()


def test_estimates_are_unbiased():
    rng = np.random.default_rng(0)
    est = []
    for _ in range(60):
        a = rng.integers(0, 2**63, 400, dtype=np.uint64)
        b = np.concatenate([a[:300], rng.integers(0, 2**63, 100, dtype=np.uint64)])
        s = neardup.signatures(neardup.minima([a, b]))
        est.append(neardup.estimate(s[0], s[1]).item())
    assert np.mean(est) == pytest.approx(300 / 500, abs=0.03)


def test_components_of_long_paths(spark):
    rng = np.random.default_rng(1)
    ids = rng.permutation(400)
    links = [(int(ids[i]), int(ids[i + 1])) for i in range(399) if i != 200]
    got = {r.nid: r.comp for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    one, two = ids[:201], ids[201:]
    assert got == {int(i): int(min(one)) for i in one} | {int(i): int(min(two)) for i in two}


def _classes(spark, sets, comp):
    mins = neardup.minima(sets)
    sig = np.ascontiguousarray(neardup.signatures(mins)).view(np.int64)
    known = spark.createDataFrame([(i, comp(i), len(x), [int(v) for v in sig[i]]) for i, x in enumerate(sets)], "nid long, comp long, n long, sig array<long>")
    return known, spark.createDataFrame([(i, [int(v) for v in x]) for i, x in enumerate(sets)], "nid long, shingles array<long>")


def test_prefix_groups_hold_all_links_between_components(spark):
    rng = np.random.default_rng(9)
    pool = rng.integers(1, 2**62, 90).astype(np.uint64)
    sets = [np.sort(rng.choice(pool[: rng.integers(50, 90)], rng.integers(30, 50), replace=False)) for _ in range(60)]
    sets += [np.sort(np.concatenate([x[2:], rng.integers(1, 2**62, 3).astype(np.uint64)])) for x in sets[:20]]
    known, full = _classes(spark, sets, lambda i: i % 7)
    every = {(i, j) for i in range(80) for j in range(i) if i % 7 != j % 7 and 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    assert len(every) > 15
    gid = {r.nid: r.gid for r in neardup._prefix_groups(known, full, 75).collect()}
    assert all(i in gid and gid[i] == gid.get(j) for i, j in every)


def test_pages_of_a_template_make_no_groups(spark):
    """Sets that share less than the threshold asks for, in one bucket: none is grouped with another, however many pages."""
    rng = np.random.default_rng(10)
    template = rng.integers(1, 2**62, 56).astype(np.uint64)
    sets = [np.sort(np.concatenate([template, rng.integers(1, 2**62, 16).astype(np.uint64)])) for _ in range(300)]
    known, full = _classes(spark, sets, lambda i: i)
    assert neardup._prefix_groups(known, full, 75).count() == 0


def test_blocks_join_all_components(spark):
    """Links of edited copies, dealt into blocks of a few classes, join what all pairs would."""
    rng = np.random.default_rng(2)
    base = rng.integers(-(2**62), 2**62, 40)
    sets = [np.unique(np.concatenate([rng.choice(base, 36, replace=False), rng.integers(-(2**62), 2**62, 2)])) for _ in range(40)]
    sig = neardup.signatures(neardup.minima([s.view(np.uint64) for s in sets]))
    members = spark.createDataFrame([(0, i, i % 7, len(sets[i]), [int(v) for v in sig[i].view(np.int64)]) for i in range(40)], "gid long, nid long, comp long, n long, sig array<long>")
    full = spark.createDataFrame([(i, [int(x) for x in s]) for i, s in enumerate(sets)], "nid long, shingles array<long>")

    def joined(links):
        root = {i: i % 7 for i in range(40)}
        for a, b in links:
            x, y = root[a], root[b]
            root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
        return root

    every = [(i, j) for i in range(40) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))]
    for weight in (100, 300, 10**6):
        got = [(r.a, r.b) for r in neardup._joining_links(members, full, 75, weight).collect()]
        assert joined(got) == joined(every)
        assert {tuple(sorted(x, reverse=True)) for x in got} <= set(every)


def brute_hits(text, items):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    w, hit, found = words(text), set(), set()
    for item, t in items:
        p = words(t)
        for k in range(max(1, len(p) - 12)) if p else ():
            win = p[k : k + 13]
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    found.add(item)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("part_bytes", [1 << 23, 60])
def test_contamination_against_brute_force(spark, docs, part_bytes):
    rng = np.random.default_rng(3)
    words = lambda n: " ".join(f"k{int(x)}" for x in rng.integers(0, 4, n))
    items = [(i, words(n)) for i, n in enumerate((15, 13, 30, 2, 1, 12, 14))] + [(7, ""), (8, None), (None, words(20)), (9, "k9 Ä-k9"), (2, words(14)), (10, items_of(1))]
    rows = [(i, words(40) + (". " + items[i % 7][1].upper() + "; k1" if i % 2 else "")) for i in range(25)] + [(50, None), (51, "..."), (52, "K9! ä"), (53, "xk9 äk9"), (54, "a"), (54, "a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(docs(*rows), bench, part_bytes=part_bytes).collect()
    real = [x for x in items if x[0] is not None]
    for r, (d, t) in zip(sorted(got, key=lambda r: r.doc_id), sorted(rows, key=lambda r: r[0]), strict=True):
        assert (r.doc_id, *tuple(r)[1:]) == (d, *brute_hits(t, real))


def items_of(n):
    return " ".join("abc"[i % 3] for i in range(n))


def test_contamination_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "same"), (2, "nothing like it")], "item_id long, text string")
    got = decontaminate.find_contamination(odd, bench).collect()
    assert [r.doc_id for r in got if r.contaminated] == [3, 3]
    kept = decontaminate.drop_contaminated(odd, bench)
    assert kept.columns == odd.columns and kept.count() == 7
    none = decontaminate.find_contamination(odd, bench.where("false"))
    assert none.count() == 9 and none.where("contaminated").count() == 0
    assert decontaminate.find_contamination(odd.where("false"), bench).count() == 0


def test_wu_manber_against_find():
    rng = np.random.default_rng(5)
    text = bytes(rng.integers(97, 100, 4000).astype(np.uint8))
    pats = [text[i : i + n] for i, n in zip(rng.integers(0, 3900, 30), rng.integers(3, 60, 30), strict=True)] + [b"abcabcabcabc", b"zzz"]
    for block in (1, 3, 16):
        distinct = sorted(set(pats))
        got = sorted((i, distinct[k]) for i, k in decontaminate.WuManber.of(distinct, block).find(text))
        want = sorted((i, p) for p in set(pats) for i in range(len(text)) if text.startswith(p, i))
        assert got == want


# repeated strings
def brute_kept(rows, length):
    count = collections.Counter()
    raw = [(t or "").encode() for _, t in rows]
    for b in raw:
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(rows, raw, strict=True):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.mark.parametrize(("shard_bytes", "memory"), [(1 << 22, 1 << 28), (2000, 0)])
def test_repeats_against_brute_force(docs, shard_bytes, memory):
    rng = np.random.default_rng(6)
    text = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    a, b = text(900), text(500)
    rows = [(1, a), (2, text(100) + a[100:600] + text(50)), (3, b + "é" + b), (4, "ab" * 400), (5, text(399)), (6, a[:399] + "."), (7, b + text(10)), (7, b), (8, None), (9, ""), (10, text(2000)), (None, a), (11, "x" * 401), (12, a[200:700] + a[150:650])]
    got = suffixes.remove_repeats(docs(*rows), shard_bytes=shard_bytes, memory=memory).collect()
    assert sorted((tuple(r[:5]) + (bytes(r.kept),) for r in got), key=str) == sorted(brute_kept(rows, 400), key=str)
    assert sorted(((r.doc_id, r.n_repeated) for r in got), key=str) == sorted(((r[0], r[2]) for r in brute_kept(rows, 280)), key=str)


def test_repeats_among_many_surroundings(docs):
    """A string met in many different texts makes its anchors hot: longer anchors, and in the end whole windows, decide."""
    rng = np.random.default_rng(16)
    text = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    rows = []
    for k, size in enumerate((70, 200, 300, 399, 420)):
        hot = text(size)
        rows += [(100 * k + i, text(int(rng.integers(0, 400))) + hot + text(int(rng.integers(0, 400)))) for i in range(12)]
    rows += [(600, rows[3][1]), (601, "z" + rows[4][1][:-3])]
    got = suffixes.remove_repeats(docs(*rows), shard_bytes=4000, memory=1 << 16).collect()
    assert sorted((tuple(r[:5]) + (bytes(r.kept),) for r in got), key=str) == sorted(brute_kept(rows, 400), key=str)
    assert sorted(((r.doc_id, r.n_repeated) for r in got), key=str) == sorted(((r[0], r[2]) for r in brute_kept(rows, 280)), key=str)


def test_pieces_that_share_only_their_anchor_are_not_sorted():
    """Of texts with one anchor in common, those that share half of a repeat's other bytes at a side of it are sorted."""
    rng = np.random.default_rng(2)
    text = lambda n: rng.integers(97, 123, n, dtype=np.uint8).tobytes()
    first = text(700)
    begin, count, place, _ = suffixes.anchors(np.frombuffer(first, np.uint8))
    k = int(np.argmax(count))
    a, n, at = int(begin[k]), int(count[k]), int(place[k])
    piece = first[a : a + n + 399]
    left = piece[: at - a + 68] + text(5) + piece[at - a + 73 :]
    other = text(at - a) + piece[at - a : at - a + 48] + text(len(piece) - (at - a) - 48)
    assert not suffixes._meeting([piece, other], [n, n], 280, 48).any()
    assert at - a >= 116 and suffixes._meeting([piece, left], [n, n], 280, 48).all()


def test_pieces_are_cut_to_what_others_of_their_anchor_share():
    """Far less is sorted than the pieces hold, and the same windows repeat as in whole pieces."""
    rng = np.random.default_rng(5)
    first = rng.integers(97, 123, 900, dtype=np.uint8)
    begin, count, place, _ = suffixes.anchors(first)
    k = int(np.argmax(count))
    a, n, at = int(begin[k]), int(count[k]), int(place[k]) - int(begin[k])
    pieces, first = [], first[a : a + n + 399]
    for before, after in ((at, 10_000), (40, 230), (100, 420), (230, 1), (5, 240), (16, 228)):
        while True:  # until all windows have the anchor still
            piece = first.copy()
            piece[: max(0, at - before)] = rng.integers(65, 91, max(0, at - before))
            piece[at + 48 + after :] = rng.integers(65, 91, len(piece[at + 48 + after :]))
            if suffixes.anchors(piece[: n + 279])[2].tolist() == [at]:
                break
        pieces.append(piece.tobytes())
    for some in (pieces[:2], pieces[1:4], pieces):
        lo, hi = suffixes._parts(some, [n] * len(some), 280, 48)
        own = np.minimum(n, hi - 279) - lo
        want = suffixes.repeated_starts(some, [n] * len(some), [1] * len(some), 400, 280)
        keep = np.flatnonzero(own > 0).tolist()
        cut = [some[i][lo[i] : hi[i]] for i in keep]
        got = dict(zip(keep, suffixes.repeated_starts(cut, own[keep].tolist(), [1] * len(cut), 400, 280), strict=True))
        for i, (short, long) in enumerate(want):
            whole = np.zeros((2, n), bool)
            if i in got:
                whole[:, lo[i] : lo[i] + own[i]] = got[i]
            assert np.array_equal(whole, [short, long])
    assert any(short.any() for short, _ in want)
    lo, hi = suffixes._parts(pieces[:2], [n, n], 280, 48)
    assert (hi - lo <= 40 + 48 + 230 + 2 * 16).all()


def test_shard_far_larger_than_memory():
    """Ten times as much text as memory: what is allocated stays near the bound, and every planted repeat is found."""
    import tracemalloc

    rng = np.random.default_rng(17)
    memory, pieces = 1 << 19, []
    for _ in range(20):
        data = rng.integers(97, 101, 1 << 18).astype(np.uint8)
        data[199_999:201_001] = data[999:2001]
        data[[199_999, 201_000]] = 122
        pieces.append(data.tobytes())
    shard = suffixes.Shard(400, 280, memory)
    for p in pieces:
        shard.add(p, len(p), 1)
    assert sum(map(len, pieces)) >= 10 * memory
    tracemalloc.start()
    found = [(int(short.sum()), int(long.sum())) for short, long in shard.repeated()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(2 * 721, 2 * 601)] * 20
    assert peak < 8 * memory, peak


def test_repeats_odd_rows(odd):
    got = {(r.doc_id, r.n_bytes): (r.n_removed, r.n_spans) for r in suffixes.remove_repeats(odd).collect()}
    assert got[(5, 100000)] == (100000, 1) and got[(1, 0)] == (0, 0) and got[(3, 4)] == (0, 0)
    assert suffixes.remove_repeats(odd.where("false")).count() == 0


def test_anchors_cover_all_windows_and_agree_on_equal_ones():
    rng = np.random.default_rng(7)
    data = rng.integers(97, 100, 1500).astype(np.uint8)
    data[900:1400] = data[100:600]
    first, count, place, h = suffixes.anchors(data, 100, 16)
    assert first[0] == 0 and (first[1:] == (first + count)[:-1]).all() and (first + count)[-1] == 1401
    owner = np.repeat(np.arange(len(first)), count)
    for s in range(100, 501):
        a, b = owner[s], owner[s + 800]
        assert h[a] == h[b] and place[a] - s == place[b] - s - 800


class Small(induced.Scratch):
    """Batches of a few entries only."""

    def __init__(self, memory, batch):
        super().__init__(memory)
        self.batch = batch


@pytest.mark.parametrize("letters", [4, 26, 900, 5000])
def test_suffix_order_and_shared_prefixes(letters):
    rng = np.random.default_rng(8)
    for trial in range(25):
        raw = rng.integers(1, rng.integers(2, letters), rng.integers(1, 300))
        if trial % 3 == 0:
            raw = np.concatenate([raw, raw[len(raw) // 2 :], raw, raw])
        if trial % 5 == 0:
            raw = np.repeat(raw, 3)
        raw = tuple(map(int, [*raw, 0]))
        depth = int(rng.choice([1, 3, 20, 2000]))
        scratch = Small(int(rng.choice([0, 1 << 28])), int(rng.choice([1, 5, 64, 4096])))
        if letters < 512:
            order, shared = induced.suffix_order(np.array(raw, np.uint16), letters, depth, scratch)
        else:
            order, shared = induced.order_suffixes(np.array(raw, np.int32), letters, depth, scratch), None
        if shared is not None:  # short prefixes may be told as any shorter ones
            least = int(rng.integers(0, depth + 1))
            again, short = induced.suffix_order(np.array(raw, np.uint16), letters, depth, scratch, least)
            assert (again == order).all() and (np.where(shared >= least, shared, 0) == np.where(short >= least, short, 0)).all()
        heads = [raw[i : i + depth] for i in order]
        assert sorted(map(int, order)) == list(range(len(raw))) and all(x <= y for x, y in zip(heads, heads[1:], strict=False))
        for k in range(1, len(raw) if shared is not None else 0):
            x, y = heads[k - 1 : k + 1]
            assert int(shared[k]) == next((i for i in range(min(len(x), len(y))) if x[i] != y[i]), min(len(x), len(y)))
