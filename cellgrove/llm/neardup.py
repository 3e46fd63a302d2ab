"""Near-duplicate documents by b-bit MinHash.

A document's set holds the 64-bit hashes of its distinct 5-word shingles. Documents with the same set
are one class; classes get 128 minima, of which the low two bits are kept as a signature, and keys of
32 bands of four whole minima each. Classes that share a band are candidates; the share of equal
two-bit minima, corrected for chance, picks those worth a look, and links are confirmed on full sets.

Not all pairs are made. First each class is held against one leader of its buckets, and the links make
components. Buckets whose classes are all in one component are done. The classes of the others are held
against those leaders of their buckets that look most alike. What is still in buckets with several components
is grouped by prefixes: with the shingles of a set in order of how rare they are, two sets as similar as
asked for share one of their first few. Groups are dealt into blocks of bounded weight, and block by block the
pairs across components are held against the estimate and confirmed, until their components are joined or none
is left. So pages that have a template in common, but less than the threshold asks for, aren't even grouped.

Null texts and texts without words have an empty set, are linked with nothing and are kept. Very long texts
have large sets, in the memory of one task each. Ties: of equal least hashes the smaller one is a leader.
component_id is the smallest doc_id that is reachable; null ids don't count for it, and a group of
null ids only has a null one and is kept. Repeated rows are in one class; each stays a row. Extra
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
BANDS, ROWS = 32, 4
BITS = 2
_N = BANDS * ROWS
_A = np.random.default_rng(5).integers(1, 2**32, _N, dtype=np.uint32) | np.uint32(1)
_B = np.random.default_rng(6).integers(0, 2**32, _N, dtype=np.uint32)
_K = np.random.default_rng(8).integers(1, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)
#: Estimates this far below the threshold are still confirmed: over four standard deviations.
SLACK = 0.22


def shingle_sets(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row of a flat text column."""
    low = common.LOWER[data]
    starts, ends, first = common.words_of(low, at, common.SPACE)
    h = common.span_hashes(low, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    m = len(h) - SHINGLE + 1
    grams = common.mix64(sum((h[k : k + m] * _K[k] for k in range(SHINGLE)), np.zeros(max(m, 0), np.uint64))) if m > 0 else h[:0]
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            s = np.sort(grams[a : b - SHINGLE + 1])
            keep = np.ones(len(s), bool)
            keep[1:] = s[1:] != s[:-1]
            out.append(s[keep])
        elif b > a:
            out.append(common.mix64((h[a:b] * _K[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(h[:0])
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """128 minima of each set, none of which is empty."""
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    start = np.cumsum([0, *map(len, sets[:-1])])
    return np.stack([np.minimum.reduceat(x * a + b, start) for a, b in zip(_A, _B, strict=True)], axis=1)


def band_keys(mins: np.ndarray) -> np.ndarray:
    groups = mins.reshape(len(mins), BANDS, ROWS).astype(np.uint64)
    key = np.zeros((len(mins), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = common.mix64(key * np.uint64(0x9E3779B97F4A7C15) + groups[:, :, k])
    return key.view(np.int64)


def signatures(mins: np.ndarray) -> np.ndarray:
    """The low bits of all minima, packed: 32 bytes for each set."""
    bits = (mins[:, :, None] >> np.arange(BITS, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.reshape(len(mins), -1).astype(np.uint8), axis=1)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from packed signatures, corrected for minima whose low bits agree by chance."""
    diff = np.ascontiguousarray(a ^ b).view(np.uint64)
    unequal = np.bitwise_count((diff | (diff >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=-1)
    chance = 2.0**-BITS
    return (1 - unequal / _N - chance) / (1 - chance)


_SKETCH = "doc_id long, nid long, n_shingles long, sig array<long>, bands array<long>"


def sketch(docs: DataFrame) -> DataFrame:
    """For each row of docs: nid (a hash of the set; null if it is empty), size, signature and band keys."""

    def run(batches):
        for batch in batches:
            data, at = common.flat(batch.column(1))
            for i, j in common.slices(at, 2 << 20):
                sets = shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i])
                size = np.array([len(s) for s in sets])
                real = np.flatnonzero(size)
                sig, bands = np.zeros((0, 32), np.uint8), np.zeros((0, BANDS), np.int64)
                if len(real):
                    mins = minima([sets[k] for k in real])
                    sig, bands = signatures(mins), band_keys(mins)
                nid, at_band = [None] * len(sets), np.zeros(len(sets) + 1, np.int32)
                for k in real.tolist():
                    s = sets[k]
                    nid[k] = int(common.mix64(np.bitwise_xor.reduce(common.mix64(s), keepdims=True) + np.uint64(len(s))).view(np.int64)[0])
                at_band[1:] = np.cumsum((size > 0) * BANDS)
                packed = pa.ListArray.from_arrays(pa.array(at_band // (BANDS // 4)), pa.array(np.ascontiguousarray(sig).view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(nid, pa.int64()), pa.array(size, pa.int64()), packed, pa.ListArray.from_arrays(pa.array(at_band), pa.array(bands.ravel()))],
                    ["doc_id", "nid", "n_shingles", "sig", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(common.released(run), _SKETCH)


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(nid, shingles) of the classes in wanted (nid, doc_id: one of its rows). Texts of other rows aren't read into Python."""

    def run(batches):
        for batch in batches:
            data, at = common.flat(batch.column(0))
            for i, j in common.slices(at, 2 << 20):
                sets = [s for s in shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i]) if len(s)]
                if sets:
                    nid = [int(common.mix64(np.bitwise_xor.reduce(common.mix64(s), keepdims=True) + np.uint64(len(s))).view(np.int64)[0]) for s in sets]
                    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(nid, pa.int64()), lists], ["nid", "shingles"])

    ids = wanted.select(F.col("doc_id").alias("wanted_id")).distinct()
    if wanted.count() <= 1_000_000:  # 8 bytes each
        ids = F.broadcast(ids)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(ids, F.expr("doc_id <=> wanted_id"), "left_semi")
    found = texts.select("text").mapInArrow(common.released(run), "nid long, shingles array<long>")
    return found.join(wanted.select("nid"), "nid", "left_semi").dropDuplicates(["nid"])


def components(links: DataFrame) -> DataFrame:
    """(nid, comp) of every end of links (a, b): comp is the smallest reachable nid. Alternates large and small stars."""
    spark = links.sparkSession
    edges = common.staged(spark, links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).where("u <> v")
        old, edges = edges, common.staged(spark, small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        common.discard(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("nid")).distinct()
    return edges.select(F.col("u").alias("nid"), F.col("v").alias("comp")).union(roots.select("nid", F.col("nid").alias("comp")))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left, right = sets.select(F.col("nid").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("nid").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _alike(a: str, b: str, percent: int) -> Column:
    """Whether the estimate from two signatures, four longs each, reaches the threshold less SLACK."""
    least = percent / 100 - SLACK
    most = int(_N * (1 - 2.0**-BITS) * (1 - least))  # of unequal minima
    diff = [F.col(a)[k].bitwiseXOR(F.col(b)[k]) for k in range(_N * BITS // 64)]
    return sum((F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(0x5555555555555555))) for d in diff), F.lit(0)) <= most


def _leader_pairs(near: DataFrame, known: DataFrame, percent: int, most: int = 4) -> DataFrame:
    """(a, b): each class of near (nid, leader, comp) with the leaders in other components that look most alike, `most` of them at most."""
    lead = known.select(F.col("nid").alias("leader"), F.col("sig").alias("lead_sig"), F.col("n").alias("lead_n"), F.col("comp").alias("lead_comp"))
    pairs = near.select("nid", "leader").where("nid <> leader").join(known, "nid").join(lead, "leader").where("comp <> lead_comp")
    pairs = pairs.where((100 * F.least("n", "lead_n") >= percent * F.greatest("n", "lead_n")) & _alike("sig", "lead_sig", percent))
    equal = sum((F.bit_count(F.col("sig")[k].bitwiseXOR(F.col("lead_sig")[k])) for k in range(_N * BITS // 64)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("nid").orderBy(equal, "leader"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= most).select(F.col("leader").alias("a"), F.col("nid").alias("b"))


def _prefix_groups(known: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(nid, gid): classes of known (nid, comp, n) in groups, so that two in different components that are similar enough are in one.

    Of such a pair the shorter set is found by its first k - ceil(2p / (1 + p) n) + 1 shingles and the longer one by its
    first k - ceil(p n) + 1, in order of how rare they are; n: its size, k: how many of its shingles lie in several
    components. Groups are made of classes that share such shingles; those that share none are left out."""
    spark = known.sparkSession
    tokens = known.select("nid", "comp", "n").join(sets, "nid").select("nid", "comp", "n", F.explode("shingles").alias("token"))
    across = tokens.groupBy("token").agg(F.count("*").alias("df"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("token", "df")
    ordered = tokens.join(across, "token").groupBy("nid").agg(F.first("comp").alias("comp"), F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("list"))
    k = F.size("list")
    probe = k - F.expr(f"({percent} * n + 99) div 100") + 1
    index = k - F.expr(f"(2 * {percent} * n + {99 + percent}) div {100 + percent}") + 1
    ordered = ordered.withColumn("probe", probe.cast("int")).withColumn("index", index.cast("int")).where("probe > 0")
    entries = ordered.select("nid", "comp", "index", F.posexplode(F.expr("slice(list, 1, probe)")).alias("at", "e")).select("nid", "comp", F.col("e.token").alias("token"), (F.col("at") < F.col("index")).alias("short"))
    entries = common.staged(spark, entries, "prefixes")
    useful = entries.groupBy("token").agg(F.min("nid").alias("first"), F.max("short").alias("short"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("short AND x <> y")
    links = entries.join(useful.select("token", "first"), "token").where("nid <> first").select(F.col("first").alias("a"), F.col("nid").alias("b")).distinct()
    return components(links).withColumnRenamed("comp", "gid")


def _blocks(members: DataFrame, weight: int) -> tuple[DataFrame, DataFrame]:
    """members (gid, nid, comp, n) with a block each, and the pairs of blocks (gid, i, j) that hold different components.

    A component heavier than `weight` has blocks of its own; the others of a group share blocks of about that weight."""
    per_comp = members.groupBy("gid", "comp").agg(F.sum("n").alias("w"))
    small = per_comp.where(F.col("w") <= weight).groupBy("gid").agg(F.sum("w").alias("small"))
    sized = per_comp.join(small, "gid", "left").select("gid", "comp", (F.col("w") > weight).alias("big"), F.ceil(F.when(F.col("w") > weight, F.col("w")).otherwise(F.col("small")) / weight).alias("parts"))
    dealt = members.join(sized, ["gid", "comp"]).withColumn("part", F.pmod(F.xxhash64(F.when(F.col("big"), F.col("nid")).otherwise(F.col("comp"))), F.col("parts")))
    dealt = dealt.withColumn("block", F.when(F.col("big"), F.xxhash64("comp", "part")).otherwise(F.col("part"))).withColumn("own", F.when(F.col("big"), F.col("comp")))
    blocks = dealt.groupBy("gid", "block").agg(F.first("own").alias("own"))
    right = blocks.select("gid", F.col("block").alias("j"), F.col("own").alias("own_j"))
    pairs = blocks.withColumnRenamed("block", "i").join(right, "gid").where("i <= j AND NOT coalesce(own = own_j, false)").select("gid", "i", "j")
    return dealt.select("gid", "block", "nid", "comp"), pairs


def _joining_links(members: DataFrame, sets: DataFrame, percent: int, weight: int = 1_000_000) -> DataFrame:
    """Confirmed links (a, b) that join components within the groups of members (gid, nid, comp, n, sig).

    Every pair of a group in different components is held against the estimate and, if that allows, confirmed on
    full sets, unless links found in the same block pair have joined their components."""
    dealt, pairs = _blocks(members.drop("sig"), weight)
    ends = pairs.select("gid", "i", "j", F.col("i").alias("block")).union(pairs.select("gid", "i", "j", F.col("j").alias("block"))).distinct()
    full = dealt.join(ends, ["gid", "block"]).join(members.select("nid", "sig").distinct(), "nid").join(sets, "nid")
    least = percent / 100 - SLACK

    def run(key, table):
        table = table.combine_chunks()
        nid, comp, block = (table.column(c).to_numpy() for c in ("nid", "comp", "block"))
        i, j = key[1].as_py(), key[2].as_py()
        sig = np.ascontiguousarray(table.column("sig").combine_chunks().flatten().to_numpy()).view(np.uint8).reshape(len(nid), -1)
        lists = table.column("shingles").combine_chunks()
        offsets = lists.offsets.to_numpy().astype(np.int64)
        _, column = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        at = offsets - offsets[0]
        size = np.diff(at)
        _, group = np.unique(comp, return_inverse=True)
        mark = np.zeros(int(column.max()) + 1 if len(column) else 1, bool)
        found = []
        for r in range(len(nid)):
            other = group != group[r]
            other &= block == (j if block[r] == i else i)
            other[: r if i == j else 0] = False
            if i != j and block[r] != i:
                continue
            c = np.flatnonzero(other)
            small, large = np.minimum(size[c], size[r]), np.maximum(size[c], size[r])
            c = c[100 * small >= percent * large]
            c = c[estimate(sig[c], sig[r]) >= least] if len(c) else c
            if not len(c):
                continue
            mark[column[at[r] : at[r + 1]]] = True
            for k in range(0, len(c), 4096):
                some = c[k : k + 4096]
                some = some[group[some] != group[r]]
                if not len(some):
                    continue
                n = size[some]
                start = np.cumsum(n) - n
                both = np.add.reduceat(mark[column[np.arange(n.sum()) + np.repeat(at[some] - start, n)]].astype(np.int64), start)
                for x in some[100 * both >= percent * (n + size[r] - both)].tolist():
                    if group[x] != group[r]:
                        found.append((int(nid[r]), int(nid[x])))
                        group[group == group[x]] = group[r]
            mark[column[at[r] : at[r + 1]]] = False
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return full.groupBy("gid", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, component_id, kept. Links: 100 * intersection >= percent * union."""
    spark = docs.sparkSession
    rows = common.staged(spark, sketch(docs), "sketch")
    classes = rows.where("nid IS NOT NULL").groupBy("nid").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = common.staged(spark, classes, "classes")
    single = classes.select("nid", F.explode("bands").alias("band"))
    shared = single.groupBy("band").agg(F.count("*").alias("n"), F.min("nid").alias("leader")).where("n > 1").drop("n")
    buckets = common.staged(spark, single.join(shared, "band"), "buckets")
    wanted = classes.join(buckets.select("nid").distinct(), "nid", "left_semi").select("nid", "doc_id")
    sets = common.staged(spark, _full_sets(docs, wanted), "sets")

    star = buckets.where("nid <> leader").groupBy("nid").agg(F.min("leader").alias("leader"))
    links = common.staged(spark, _confirmed(star.select(F.col("leader").alias("a"), F.col("nid").alias("b")), sets, percent), "links")
    comps = common.staged(spark, components(links), "comps")
    for last in (False, True):
        with_comp = buckets.join(comps, "nid", "left").withColumn("comp", F.coalesce("comp", "nid"))
        mixed = with_comp.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("band")
        near = common.staged(spark, with_comp.join(mixed, "band", "left_semi").select("nid", "leader", "comp").distinct(), "near")
        if near.isEmpty():
            break
        known = near.select("nid", "comp").distinct().join(classes.select("nid", "sig", F.col("n_shingles").alias("n")), "nid")
        known = common.staged(spark, known, "known")
        if last:
            members = common.staged(spark, known.join(_prefix_groups(known, sets, percent), "nid"), "members")
            new = common.staged(spark, _joining_links(members, sets, percent), "links")
        else:
            new = common.staged(spark, _confirmed(_leader_pairs(near, known, percent), sets, percent), "links")
        if not new.isEmpty():
            links = links.union(new)
            comps = common.staged(spark, components(links), "comps")

    ids = classes.select("nid", "doc_id").join(comps, "nid", "left").withColumn("comp", F.coalesce("comp", "nid"))
    smallest = ids.join(comps.select("comp").distinct(), "comp", "left_semi").groupBy("comp").agg(F.min("doc_id").alias("least_id"))
    ids = ids.join(smallest, "comp", "left").select("nid", F.when(F.col("least_id").isNotNull(), F.col("least_id")).otherwise(F.col("doc_id")).alias("component_id"))
    linked = rows.select("doc_id", "nid", "n_shingles").where("nid IS NOT NULL").join(ids, "nid").select("doc_id", "n_shingles", "component_id")
    alone = rows.where("nid IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of docs, all columns, with one document of each group. A doc_id stands for one document: rows
    that share one stay or go together, and of those that stay and have the same text one is left."""
    spark = docs.sparkSession
    found = common.staged(spark, near_duplicates(docs, percent), "groups")
    gone_id, twice_id = common.unused("gone_id", docs), common.unused("twice_id", docs)
    gone = found.where("NOT kept").select(F.col("doc_id").alias(gone_id)).distinct()
    if gone.count() <= 1_000_000:  # 8 bytes each
        gone = F.broadcast(gone)
    left = docs.join(gone, F.col("doc_id").cast("long") == F.col(gone_id), "left_anti")
    twice = found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(twice_id))
    twice = common.staged(spark, twice, "twice")
    if twice.isEmpty():
        return left
    same = F.col("doc_id").cast("long") == F.col(twice_id)
    return left.join(twice, same, "left_anti").union(left.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: For op6: all pairs that share a shingle, compared exactly.
SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
sets AS (SELECT DISTINCT doc_id, g FROM grams),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach(id, comp) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.comp FROM reach r JOIN links l ON l.a = r.id AND r.comp < l.b),
comps AS (SELECT id, min(comp) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN comps ON comps.id = d.doc_id
"""
