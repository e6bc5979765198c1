"""Exact n-gram Jaccard self-join with PartEnum signatures.

Sets of word shingles link when ``100 * |A & B| >= 80 * |A | B|``.  Then their symmetric
difference is at most ``(|A| + |B|) / 9``.  Shingle hashes are split over the ``m`` parts of a
domain partition that all sets of one size band share; two linked sets agree on at least
``m - k`` whole parts.  Each set keeps its ``k + 1 + x`` best parts (most elements first; the order
depends on the content alone), so linked sets share at least ``x + 1`` kept signatures; after the
signatures are counted, each set may drop its ``x`` most frequent ones and linked sets still share
one.  That rids documents with passages, licences or menus in common of nearly all false candidates
without a cap.  Sets near a band's edge are put in both bands, so no pair is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .runtime import drop, restrict, small_batches, store, tidy
from .textblocks import blocks, mix, signed

WORDS = 5
#: Elements and sets of one block at most, where sets that share signatures but no component are compared: a task holds
#: two blocks and an overlap of BLOCK_SETS ** 2.  (A set of more than BLOCK elements is a block of its own.)
BLOCK, BLOCK_SETS = 150_000, 2_000
#: Members of a signature in one chain; a more frequent signature has several chains, all joined to its first member.
CHAIN = 5_000
#: Elements that a matrix product of two blocks takes at once.
STRIP = 1_024
#: Sizes of one band: LOWEST * BAND**i and up, to a factor of BAND (and a quarter more, for the overlap).
LOWEST, BAND = 4, 4


def reach(n: int) -> int:
    """Largest symmetric difference of a set of n with any set that links with it."""
    return (n + n * 5 // 4) // 9


def bands(n: int) -> list[tuple[int, int, int]]:
    """(band, parts, droppable) of each band in which a set of n takes part."""
    out, i, lo = [], 0, LOWEST
    while lo <= n:
        if n < lo * BAND * 5 // 4 + 1:
            x = max(1, lo // 10)
            k = reach(lo * BAND * 5 // 4 + 1)
            out.append((i, (k + 1) * 3 // 2 + x, x))
        i, lo = i + 1, lo * BAND
    return out


def part_signatures(s: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(band, droppable, signatures) of one sorted set of uniform 64-bit hashes."""
    out = []
    for band, m, x in bands(len(s)):
        part = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # rises with s: parts are runs
        at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        size = np.diff(np.append(at, len(s)))
        content = np.add.reduceat(mix(s), at)
        sig = mix(content ^ mix(part[at] + np.uint64((band + 1) << 40)))
        keep = reach(len(s)) + 1 + x
        if keep > len(sig):  # some empty parts count too: the worst, in the order of their numbers
            empty = np.setdiff1d(np.arange(m, dtype=np.uint64), part[at])[: keep - len(sig)]
            sig = np.concatenate((sig, mix(empty + np.uint64((band + 1) << 40 | 1 << 56))))
        elif keep < len(sig):
            sig = sig[np.lexsort((sig, -size))[:keep]]
        out.append((band, x, sig))
    return out


def _digests(words: int):
    def run(batches):
        for b in batches:
            for i, j, block in blocks(b, lower=True):
                sets = block.shingle_sets(words)
                n = np.array([len(s) for s in sets], np.int64)
                two = np.zeros((len(sets), 2), np.uint64)
                for d, s in enumerate(sets):
                    two[d] = mix(s ^ np.uint64(0xA5A5)).sum(dtype=np.uint64), mix(s ^ np.uint64(0x5A5A0000)).sum(dtype=np.uint64)
                two = signed(two)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n), pa.array(two[:, 0]), pa.array(two[:, 1])], ["doc_id", "n_shingles", "h1", "h2"])

    return tidy(run)


def _signatures(words: int):
    def run(batches):
        for b in batches:
            for i, _, block in blocks(b, lower=True):
                ids, sigs, band, x = [], [], [], []
                for d, s in enumerate(block.shingle_sets(words)):
                    for k, drop_, sig in part_signatures(s):
                        ids.append(np.full(len(sig), b.column(0)[i + d].as_py(), np.int64))
                        sigs.append(sig)
                        band.append(np.full(len(sig), k, np.int32))
                        x.append(np.full(len(sig), drop_, np.int32))
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(sigs))), *(pa.array(np.concatenate(a)) for a in (ids, band, x))], ["sig", "doc_id", "band", "x"])

    return tidy(run)


def _sets(words: int):
    def run(batches):
        for b in batches:
            for i, j, block in blocks(b, lower=True):
                blobs = [s.tobytes() for s in block.shingle_sets(words)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(blobs, pa.binary())], ["doc_id", "members"])

    return tidy(run)


@tidy
def _linked(batches):
    for b in batches:
        left, right = b.column(2).to_pylist(), b.column(3).to_pylist()
        ok = np.zeros(len(left), bool)
        for i, (p, q) in enumerate(zip(left, right, strict=True)):
            u, v = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            both = np.concatenate((u, v))
            both.sort(kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            ok[i] = 100 * common >= 80 * (len(both) - common)
        t = pa.Table.from_batches([b]).select([0, 1]).filter(pa.array(ok))
        yield from t.to_batches()


def verified(pairs: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets link; only documents in a pair are read again."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    sets = restrict(docs, store(ids, "ids"), "doc_id").mapInArrow(_sets(words), "doc_id long, members binary")
    left = sets.select(F.col("doc_id").alias("a"), F.col("members").alias("p"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("members").alias("q"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "p", "q").mapInArrow(_linked, "a long, b long")


@tidy
def _dense_links(key: tuple, table: pa.Table) -> pa.Table:
    """Links between block i and block j of a cluster, as many as join all that they link: overlaps are matrix products."""
    ids = np.array(table.column("doc_id"))
    block = np.array(table.column("block"))
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("members")]
    size = np.array([len(x) for x in sets])
    rows, cols = (np.flatnonzero(block == key[k].as_py()) for k in (1, 2))
    every, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    u, inv, times = np.unique(every, return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1  # only elements of two sets or more can overlap
    shared = (times > 1)[inv]
    element, of = number[inv[shared]], of[shared]
    order = np.argsort(element, kind="stable")
    element, of = element[order], of[order]
    overlap = np.zeros((len(rows), len(cols)), np.float32)
    place = np.full((2, len(sets)), -1)
    place[0, rows], place[1, cols] = np.arange(len(rows)), np.arange(len(cols))
    pair = [np.zeros((n, STRIP), np.float32) for n in (len(rows), len(cols))]
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, STRIP):
        s = slice(*np.searchsorted(element, (lo, lo + STRIP)))
        for k, m in enumerate(pair):
            m[:] = 0
            at = place[k, of[s]]
            m[at[at >= 0], element[s][at >= 0] - lo] = 1
        overlap += pair[0] @ pair[1].T
    del pair
    root = np.arange(len(sets))
    out = []
    for x, a in enumerate(rows):  # a row at a time: no second matrix of the blocks' size
        common = overlap[x].astype(np.int64)
        linked = 100 * common >= 80 * (size[a] + size[cols] - common)
        for b in cols[linked & (cols > a) if key[1] == key[2] else linked]:
            i, j = a, b
            while root[i] != i:
                root[i] = i = root[root[i]]
            while root[j] != j:
                root[j] = j = root[root[j]]
            if i != j:
                root[max(i, j)] = min(i, j)
                out.append((ids[a], ids[b]))
    out = np.array(out, np.int64).reshape(-1, 2)
    return pa.table([pa.array(out.min(1, initial=2**62)), pa.array(out.max(1, initial=-(2**62)))], ["a", "b"])


def compared_in_blocks(clusters: DataFrame, sizes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """Links (a, b) that join all linked sets of each cluster (doc_id, cluster); sizes: (doc_id, n).

    A cluster too large for one block is cut by set size, then by hash, into blocks of about ``BLOCK`` elements and ``BLOCK_SETS`` sets; only
    blocks whose sizes can link meet, one task for each two blocks, and what a task sends on is a forest, not all pairs.
    """
    sized = store(clusters.join(sizes, "doc_id"), "sized")
    large = sized.groupBy("cluster").agg(F.sum("n").alias("elements"), F.count(F.lit(1)).alias("sets"))
    large = store(large.where((F.col("elements") > BLOCK) | (F.col("sets") > BLOCK_SETS)).select("cluster", F.lit(True).alias("large")), "large")
    sized = sized.join(large, "cluster", "left").select("doc_id", "cluster", "n", F.when(F.col("large"), F.floor(F.log2("n") * 8).cast("int")).otherwise(0).alias("step"))
    steps = sized.groupBy("cluster", "step").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.sum("n").alias("elements"), F.count(F.lit(1)).alias("sets"))
    parts = F.ceil(F.greatest(F.col("elements") / BLOCK, F.col("sets") / BLOCK_SETS)).cast("int")
    steps = store(steps.select("cluster", "step", "lo", "hi", parts.alias("parts")), "steps")
    placed = sized.join(steps.select("cluster", "step", "parts"), ["cluster", "step"]).select("doc_id", "cluster", "step", F.pmod(F.xxhash64("doc_id"), "parts").cast("int").alias("part"))
    each = steps.select("cluster", "step", "lo", "hi", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    each = each.withColumn("block", F.col("step").cast("long") * (1 << 32) + F.col("part"))
    meet = each.select("cluster", "hi", F.col("block").alias("i")).join(each.select("cluster", "lo", F.col("block").alias("j")), "cluster")
    meet = meet.where("i <= j and 10 * hi >= 8 * lo").select("cluster", "i", "j")
    both = meet.select("*", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    dealt = placed.withColumn("block", F.col("step").cast("long") * (1 << 32) + F.col("part")).join(both, ["cluster", "block"]).select("doc_id", "cluster", "i", "j", "block")
    sets = restrict(docs, clusters, "doc_id").mapInArrow(_sets(words), "doc_id long, members binary")
    return dealt.join(sets, "doc_id").groupBy("cluster", "i", "j").applyInArrow(_dense_links, "a long, b long")


def copies_of(digest: DataFrame) -> DataFrame:
    """(doc_id, rep): documents whose set equals that of a smaller doc_id, the least of which is rep.  Ids with different sets are left out."""
    known = digest.where("doc_id is not null and n_shingles > 0")
    reps = known.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("top")).where("rep <> top").drop("top")
    reps = store(reps, "reps")  # read back, so that a hot set's rows are split among tasks
    of = lambda f: [f(c).alias(f"{f.__name__}_{c}") for c in ("h1", "h2", "n_shingles")]
    clash = digest.where("doc_id is not null").groupBy("doc_id").agg(*of(F.min), *of(F.max)).where("min_h1 <> max_h1 or min_h2 <> max_h2 or min_n_shingles <> max_n_shingles")
    clash = store(clash.select("doc_id"), "clash")
    out = known.join(reps, ["h1", "h2", "n_shingles"]).where("doc_id <> rep").select("doc_id", "rep")
    out = store(restrict(out, clash, "doc_id", "left_anti"), "copies")
    drop(reps, clash)
    return out


def ngram_jaccard_join(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Null, empty and blank texts have empty sets and link with nothing; an empty table gives no rows.  Equal sets
    collapse to one representative (the smallest doc_id) and rejoin at the end.  Rows that share a doc_id are one
    document: each has its own n_shingles, and the document links by any of its texts.  Rows without a doc_id are
    not compared and have no component.  Other columns are ignored, whatever their names; long texts are taken whole.
    Candidate groups are resolved by a star and chains of pairs first; documents of signatures whose
    members still lie in different components are compared in blocks, so that no link that could
    join two components is left out and no pair of a group is sent out.
    """
    small_batches(documents.sparkSession)
    every = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = every.where("doc_id is not null")
    digest = store(every.mapInArrow(_digests(words), "doc_id long, n_shingles long, h1 long, h2 long"), "digests")
    extra = copies_of(digest)
    unique = restrict(docs, extra, "doc_id", "left_anti")
    sigs = unique.mapInArrow(_signatures(words), "sig long, doc_id long, band int, x int")
    counts = store(sigs.groupBy("sig").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "counts")
    worst = Window.partitionBy("doc_id", "band").orderBy(F.desc("c"), "sig")
    kept = sigs.join(counts, "sig").withColumn("r", F.row_number().over(worst)).where("r > x").select("sig", "doc_id", "c").distinct()
    kept = store(kept, "kept")
    heads = store(kept.groupBy("sig").agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("top")).where("m <> top").select("sig", "m"), "heads")
    chain = Window.partitionBy("sig", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("c") / CHAIN))).orderBy("doc_id")
    star = kept.join(heads, "sig").where("doc_id <> m").select(F.col("m").alias("a"), F.col("doc_id").alias("b"))
    star = star.union(kept.select(F.lag("doc_id").over(chain).alias("a"), F.col("doc_id").alias("b")).where("a <> b"))
    star = store(star.distinct(), "pairs")
    links = store(verified(star, unique, words), "links")
    labels = components(links)
    tagged = kept.join(labels.toDF("doc_id", "new"), "doc_id", "left").select("sig", "doc_id", F.coalesce("new", "doc_id").alias("label"))
    bounds = tagged.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("doc_id").alias("head")).where("lo <> hi").select("sig", "head")
    bounds = store(bounds, "bounds")
    open_ = store(kept.select("sig", "doc_id").join(bounds, "sig").select("doc_id", "head").distinct(), "open")
    if not open_.isEmpty():
        clusters = components(open_.select(F.col("head").alias("a"), F.col("doc_id").alias("b"))).toDF("doc_id", "cluster")
        sizes = digest.groupBy("doc_id").agg(F.max("n_shingles").alias("n"))
        more = store(compared_in_blocks(clusters, sizes, unique, words), "links")
        if not more.isEmpty():
            labels = components(links.union(more))
    drop(counts, kept, heads, star, bounds, open_, links)
    reps = extra.groupBy("doc_id").agg(F.min("rep").alias("rep"))
    out = digest.select("doc_id", "n_shingles").join(reps, "doc_id", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    out = out.join(labels.toDF("rep", "label"), "rep", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("label", "rep").alias("component_id"))
