"""Removal of repeated byte strings by column-wise multi-document suffix sorting.

Every window of ``LENGTH`` bytes belongs to its minimiser, the least hash of the ``SEED``-byte strings
in it, so equal windows always meet under one key.  Runs of windows with one minimiser are segments;
segments whose key occurs once can't repeat, equal segments collapse to their first occurrence.  The
rest are the collections of suffix sorting: the segments of a bucket stand aligned at their keys and
one symbol of each is inserted per round, from the last column to the first.  A round turns the order and
the common prefixes of the suffixes after a column into those before it (a stable sort by the inserted
symbols, the column of the collection's Burrows-Wheeler transform, and range minima of common prefixes),
reading and writing them in sequence; only the latest column is kept, as the round after needs no other.
Suffixes that have ``LENGTH`` symbols in common with a neighbour are repeats of the first of their run.
A key with too many different segments is split by the bytes beside it: a window has at least half of its other
bytes before or after the key's, so equal windows agree on that half and meet under it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import drop, restrict, small_batches, store, tidy
from .textblocks import _BYTE, mix, powers, signed, span_hash, text_buffers

LENGTH, SEED = 100, 32
#: Window starts handled at once, bytes of segments in one bucket, packed interval bytes that may be broadcast.
SLICE, BUCKET_BYTES, BROADCAST_BYTES = 1 << 18, 4 << 20, 16 << 20
#: Different segments of one key in a task at most (about as many bytes as a bucket); beyond it the key is split.
HOT = 20_000
_POS = np.uint64((1 << 24) - 1)


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each ``width`` neighbours, by doubling."""
    m, w = h, 1
    while 2 * w <= width:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    return np.minimum(m[: len(m) - (width - w)], m[width - w :]) if width > w else m


def slices(raw: np.ndarray, off: np.ndarray):
    """(first document, documents, start, end of bytes) pieces: whole documents, or parts of one with an overlap of LENGTH - 1."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE, "right")) - 1)
        if j == i + 1 and off[j] - off[i] > 2 * SLICE:
            for s in range(int(off[i]), int(off[j]) - LENGTH + 1, SLICE):
                yield i, j, s, min(s + SLICE + LENGTH - 1, int(off[j]))
        else:
            yield i, j, int(off[i]), int(off[j])
        i = j


def segments(buf: np.ndarray, off: np.ndarray, length: int = LENGTH, seed: int = SEED):
    """Of each run of windows with one minimiser: document, first window start, windows, place of the minimiser, its hash."""
    n = len(buf)
    if n < length:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    pw, inv = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[buf] * pw[:n], out=sums[1:])
    h = mix((sums[seed:] - sums[: n - seed + 1]) * inv[: n - seed + 1])
    least = _sliding_min((h & ~_POS) | np.arange(len(h), dtype=np.uint64), length - seed + 1)
    at = (least & _POS).astype(np.int64)
    doc = np.searchsorted(off, np.arange(len(at)), "right") - 1
    ok = np.arange(len(at)) + length <= off[doc + 1]
    start = np.flatnonzero(ok)
    at, doc = at[start], doc[start]
    if not len(start):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1))))
    return doc[new], start[new], np.diff(np.append(new, len(start))), at[new], h[at[new]]


@tidy
def _find(batches):
    for b in batches:
        ids = np.array(b.column(0))
        raw, off = text_buffers(b.column(1))
        for i, j, s, e in slices(raw, off):
            buf = raw[s:e]
            local = np.clip(off[i : j + 1] - s, 0, e - s)
            doc, start, n, at, key = segments(buf, local)
            if len(doc):
                seg = span_hash(buf, start, start + n + LENGTH - 1)
                _, first, inv, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                salt = (1 + np.arange(len(key)) % 1021).astype(np.int32)  # the first of a key here is counted, the others are known to be several
                salt[first] = 0
                cols = [signed(key), signed(seg), ids[i + doc], s + start - off[i + doc], n.astype(np.int32), (at - start).astype(np.int32), salt, times[inv] > 1]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "seg", "doc_id", "start", "n", "at", "salt", "several"])


@tidy
def _extract(batches):
    """The bytes of the listed segments."""
    for b in batches:
        raw, off = text_buffers(b.column(1))
        out = []
        for d, (i, wanted) in enumerate(zip(b.column(0), b.column(2), strict=True)):
            base, end = int(off[d]), int(off[d + 1])
            for x in wanted.as_py():
                if x["start"] + x["n"] + LENGTH - 1 <= end - base:
                    s = base + x["start"]
                    out.append((x["key"], i.as_py(), x["start"], x["n"], x["at"], raw[s : s + x["n"] + LENGTH - 1].tobytes()))
            if len(out) > 5000:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["key", "doc_id", "start", "n", "at", "bytes"])


def repeated_starts(key, doc, start, n, at, parts: list[bytes], length: int = LENGTH):
    """(segment, offset in it) of every window that also starts earlier, by column-wise insertion.

    Column x holds the byte at distance x from the key's place.  ``order`` sorts the suffixes that start
    in the column inserted last, ``common`` has the symbols each shares with the one before it.
    """
    m = len(parts)
    lead, size = np.asarray(at, np.int64), np.array([len(p) for p in parts], np.int64)
    base = np.concatenate(([0], np.cumsum(size)))
    text = np.frombuffer(b"".join(parts), np.uint8)
    _, group = np.unique(key, return_inverse=True)
    order = np.argsort(group, kind="stable")
    common = np.zeros(m, np.int64)  # empty suffixes share nothing
    doc, start, n = np.asarray(doc), np.asarray(start), np.asarray(n)
    found_seg, found_off = [], []
    for x in range(int((size - lead).max(initial=0)) - 1, -int(lead.max(initial=0)) - 1, -1):
        place = lead + x  # offset in the segment of this column
        inside = (place >= 0) & (place < size)
        symbol = np.zeros(m, np.int64)
        symbol[inside] = text[base[:-1][inside] + place[inside]].astype(np.int64) + 1  # 0: nothing stands here
        s = symbol[order]
        g = group[order]
        by = np.argsort(g * 257 + s, kind="stable")
        moved = by  # ranks before the insertion, in the order after it
        same = np.zeros(m, bool)
        same[1:] = (g[moved[1:]] == g[moved[:-1]]) & (s[moved[1:]] == s[moved[:-1]]) & (s[moved[1:]] > 0)
        fresh = np.zeros(m, np.int64)
        k = np.flatnonzero(same)
        if len(k):  # common symbols of neighbours that keep their order: one more than the least between them
            span = np.stack((moved[k - 1] + 1, moved[k] + 1), 1).ravel()
            low = np.minimum.reduceat(np.append(common, 0), span)[::2]
            fresh[k] = low + 1
        order, common = order[by], fresh
        window = inside[order] & (place[order] < n[order])
        if x <= 0 and window.any():
            run = np.cumsum(common < length) - 1
            r, seg = run[window], order[window]
            at_text = start[seg] + place[seg]
            first = np.lexsort((at_text, doc[seg], r))
            r, seg, at_text = r[first], seg[first], at_text[first]
            head = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
            head = np.repeat(head, np.diff(np.append(head, len(r))))
            later = (doc[seg] != doc[seg[head]]) | (at_text != at_text[head])  # a repeated row is no later copy
            found_seg.append(seg[later])
            found_off.append(place[seg[later]])
    if not found_seg:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_seg), np.concatenate(found_off)


@tidy
def _bucket(key: tuple, table: pa.Table) -> pa.Table:
    k, doc, start, n, at = (np.array(table.column(c)) for c in ("key", "doc_id", "start", "n", "at"))
    seg, off = repeated_starts(k, doc, start, n, at, table.column("bytes").to_pylist())
    order = np.lexsort((off, seg))
    seg, off = seg[order], off[order]
    if not len(seg):
        return pa.table({c: pa.array([], pa.int64()) for c in ("doc_id", "lo", "hi")})
    new = np.flatnonzero(np.concatenate(([True], (seg[1:] != seg[:-1]) | (off[1:] != off[:-1] + 1))))
    last = np.append(new[1:], len(seg)) - 1
    lo = start[seg[new]] + off[new]
    return pa.table([pa.array(doc[seg[new]]), pa.array(lo), pa.array(start[seg[last]] + off[last] + 1)], ["doc_id", "lo", "hi"])


@tidy
def _merged(batches):
    """Runs of repeated window starts of each document as sorted, disjoint byte intervals, packed."""
    for b in batches:
        out = []
        for runs in b.column(1):
            merged: list[list[int]] = []
            for lo, hi in sorted((x["lo"], x["hi"] + LENGTH - 1) for x in runs.as_py()):
                if merged and lo <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], hi)
                else:
                    merged.append([lo, hi])
            out.append(np.array(merged, "<i8").tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "gone"])


@tidy
def _cut(batches):
    for b in batches:
        ids = b.column(0)
        rows = []
        for i, text, gone in zip(ids, b.column(1), b.column(2), strict=True):
            raw = (text.as_py() or "").encode()
            spans = np.frombuffer(gone.as_py() or b"", "<i8").reshape(-1, 2)
            kept, at = [], 0
            for lo, hi in spans:
                kept.append(raw[at:lo])
                at = hi
            kept.append(raw[at:])
            left = b"".join(kept)
            rows.append((i.as_py(), len(raw), len(raw) - len(left), len(spans), left))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


_PART = "key long, doc_id long, start long, n int, at int, bytes binary"


@tidy
def _split(batches):
    """Each segment's windows with half of their bytes beside the agreed ones before them, and those with half after them, under keys of that half."""
    for b in batches:
        out = []
        key, doc, start, n, at, raw, left, right = (b.column(k).to_pylist() for k in range(8))
        for r in range(len(b)):
            half = (LENGTH - SEED - left[r] - right[r] + 1) // 2
            buf, a = np.frombuffer(raw[r], np.uint8), at[r]
            before, after = (0, min(n[r] - 1, a - left[r] - half)), (max(0, a + SEED + right[r] + half - LENGTH), n[r] - 1)
            for side, (lo, hi) in enumerate((before, after)):
                if lo <= hi:
                    s = a - left[r] - half if side == 0 else a + SEED + right[r]
                    h = span_hash(buf, np.array([s]), np.array([s + half]))[0] if half else np.uint64(0)
                    new = int(signed(mix(np.array([key[r]], np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ h + np.uint64(side)))[0])
                    out.append((new, doc[r], start[r] + lo, hi - lo + 1, a - lo, raw[r][lo : hi + LENGTH], left[r] + (half if side == 0 else 0), right[r] + (half if side else 0)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["key", "doc_id", "start", "n", "at", "bytes", "left", "right"])


def split_hot(parts: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """``parts`` with no more than ``most`` different segments under a key, and the (doc_id, lo, hi) that were found to be equal meanwhile.

    A key's agreed bytes grow by half of the rest with each round, so eight rounds end with whole windows, which are equal.
    """
    done, equal, rows = None, None, parts.withColumns({"left": F.lit(0), "right": F.lit(0)})
    place, same = F.struct("doc_id", "start"), ["key", "n", "at", "bytes"]
    while True:
        hot = store(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > most).select("key"), "hot")
        if hot.isEmpty():
            drop(hot)
            cool = rows.drop("left", "right")
            return (cool if done is None else done.union(cool)), equal
        cool = restrict(rows, hot, "key", "left_anti").drop("left", "right")
        done = cool if done is None else done.union(cool)
        fresh = store(restrict(rows, hot, "key").mapInArrow(_split, f"{_PART}, left int, right int"), "halves")
        heads = store(fresh.groupBy(*same).agg(F.min(place).alias("head"), F.max("left").alias("left"), F.max("right").alias("right")), "heads")
        again = fresh.select(*same, "doc_id", "start").join(heads.select(*same, "head"), same).where(place != F.col("head"))
        again = again.select("doc_id", F.col("start").alias("lo"), (F.col("start") + F.col("n")).alias("hi"))
        equal = again if equal is None else equal.union(again)
        rows = heads.select("key", "head.doc_id", "head.start", "n", "at", "bytes", "left", "right")


def remove_repeats(documents: DataFrame, most: int = HOT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (bytes).

    A byte goes if a 100-byte string that covers it also starts earlier (smaller doc_id, or earlier in the
    same document); strings never cross documents.  Null texts are empty; an empty table gives no rows; long texts are
    taken whole.  Equal texts collapse to the least doc_id first; rows of one doc_id and text count as one document.
    Rows without a doc_id, and rows that share a doc_id and differ in text, have no place in the order: they are kept
    whole and are not compared.  Other columns are ignored, whatever their names.  ``most`` bounds a key's segments in a task.
    """
    small_batches(documents.sparkSession)
    every = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = every.where("doc_id is not null")
    digest = store(known.select("doc_id", F.octet_length("text").cast("long").alias("n"), F.md5(F.col("text").cast("binary")).alias("md5")), "digests")
    clash = store(digest.groupBy("doc_id").agg(F.min("md5").alias("lo"), F.max("md5").alias("hi")).where("lo <> hi").select("doc_id"), "clash")
    docs = restrict(known, clash, "doc_id", "left_anti")
    long = restrict(digest.where(F.col("n") >= LENGTH), clash, "doc_id", "left_anti")
    heads = store(long.groupBy("md5", "n").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("top")).where("head <> top").drop("top"), "firsts")
    copies = store(long.join(heads, ["md5", "n"]).where("doc_id <> head").select("doc_id", "n"), "copies")
    drop(heads)
    unique = restrict(docs.where(F.octet_length("text") >= LENGTH), copies, "doc_id", "left_anti")
    found = unique.mapInArrow(_find, "key long, seg long, doc_id long, start long, n int, at int, salt int, several boolean")
    shared = found.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("key", "salt"))).where("c > 1 or several").drop("c", "salt", "several")
    shared = store(shared, "segments")
    place = F.struct("doc_id", "start")
    heads = store(shared.groupBy("key", "seg", "n", "at").agg(F.min(place).alias("head")), "heads")
    equal = shared.join(heads, ["key", "seg", "n", "at"]).where(place != F.col("head")).select("doc_id", F.col("start").alias("lo"), (F.col("start") + F.col("n")).alias("hi"))
    several = store(heads.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "several")
    todo = store(heads.join(several, "key").select("key", "n", "at", "head.doc_id", "head.start"), "collection")
    wanted = todo.groupBy("doc_id").agg(F.collect_list(F.struct("key", "start", "n", "at")).alias("wanted"))
    listed = restrict(docs, todo, "doc_id").join(wanted, "doc_id").select("doc_id", "text", "wanted")
    taken = store(listed.mapInArrow(_extract, _PART), "parts")
    parts, twice = split_hot(taken, most)
    size = todo.agg(F.sum(F.col("n") + LENGTH)).first()[0] or 0
    buckets = int(max(1, -(-size // BUCKET_BYTES)))
    runs = parts.groupBy(F.pmod("key", F.lit(buckets)).alias("bucket")).applyInArrow(_bucket, "doc_id long, lo long, hi long")
    intervals = runs.union(equal.select("doc_id", "lo", F.col("hi").cast("long"))).union(copies.select("doc_id", F.lit(0).cast("long"), F.col("n") - LENGTH + 1))
    if twice is not None:
        intervals = intervals.union(twice.select("doc_id", "lo", F.col("hi").cast("long")))
    gone = store(intervals.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("runs")).mapInArrow(_merged, "doc_id long, gone binary"), "gone")
    drop(digest, clash, copies, shared, heads, several, todo, taken)
    if (gone.agg(F.sum(F.octet_length("gone") + 16)).first()[0] or 0) <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    return every.join(gone, "doc_id", "left").select("doc_id", "text", "gone").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
