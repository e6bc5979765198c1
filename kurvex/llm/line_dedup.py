"""Line deduplication with a deletion-neighbourhood join.

A line is its sequence of lower-case words.  A line occurrence is removed when an equal line (of at
least ``exact_words`` words), or one within ``edits`` word edits (substitution, insertion or deletion; lines of
at least ``min_words`` words), first occurs earlier in the order (doc_id, line number).
Every candidate line emits itself and each variant with up to ``edits`` words deleted, as a key of two
independent hashes (64 and 32 bits) with the deleted places.  What two lines have in common decides their distance:
variants of one deletion at one place differ by that one substitution, a line that equals a variant of
another by the words deleted there, and so on (``near_keys``).  So equal keys of those kinds are the
verification, up to a collision of 96 bits, no text is sent, and the least occurrence of each key finds
the earlier line by aggregates alone: no group is ever paired.
Candidates are lines that share a piece with a different line: edits + 1 pieces can't all be hit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_lines import lines_of, run_hash
from .runtime import BROADCAST_KEYS, drop, small_batches, store, tidy
from .textblocks import _LANES, blocks, mix, powers, signed

#: With one edit in five words at most, near lines are equal to four fifths.
MIN_WORDS, EDITS = 5, 1
#: Variants that a task makes at once (one line's at least).
VARIANTS = 1 << 16
_SECOND = np.uint64(0x2D358DCCAA6C78A5)


def _line_rows(block, min_words: int):
    """Document, line number, word range and hash of every long enough line."""
    doc, start, _, a, z = lines_of(block)
    cut = np.flatnonzero(block.buf == 10)
    number = np.searchsorted(cut, start) - np.searchsorted(cut, block.off[doc])
    ok = z - a >= min_words
    doc, a, z, number = doc[ok], a[ok], z[ok], number[ok]
    return doc, number.astype(np.int32), a, z, run_hash(block.words, a, z)


def short(h: np.ndarray) -> np.ndarray:
    """The upper half of each hash, as a signed number: enough to select candidates, and half the room."""
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _pieces(words, a, z, edits: int) -> list[np.ndarray]:
    """Hashes of pieces of each line (0: none), of which lines within ``edits`` word edits share one.

    One edit: the first or the last half stays whole; p words, p either half of the length.  Two edits: the first
    or the last third stays whole, or else one edit falls on each and the middle moves by a word at most; thirds of
    every length within two words.
    """
    n, out = z - a, []
    if edits == 1:
        for k, p in enumerate(((n - 1) // 2, n // 2)):
            for side, (s, e) in enumerate(((a, a + p), (z - p, z))):
                h = mix(run_hash(words, s, e) + p.astype(np.uint64) * _LANES[50 + side])
                out.append(np.where((n % 2 == 1) & (k == 1), np.uint64(0), h))
        return out
    last = np.full(len(n), -1)
    out.append(np.where(n <= 6, np.uint64(1), np.uint64(0)))  # too short for thirds: all are compared
    for m in range(-2, 3):
        f = np.maximum((n + m - 2) // 3, 0)
        use = (f > 0) & (f != last)
        last = f
        for side, s in enumerate((a, z - f, a + f, a + f + 1, a + f + 2)):
            e = np.minimum(s + f, z)
            h = mix(run_hash(words, s, np.maximum(e, s)) + f.astype(np.uint64) * _LANES[50 + min(side, 2)])
            out.append(np.where(use & (s + f <= z), h, np.uint64(0)))
    return out


def _emit_lines(min_words: int, exact_words: int, edits: int):
    def run(batches):
        for b in batches:
            ids = np.array(b.column(0))
            for i, _, block in blocks(b, lower=True):
                doc, number, a, z, h = _line_rows(block, min(min_words, exact_words))
                found = np.stack([np.where(z - a >= min_words, x, np.uint64(0)) for x in _pieces(block.words, a, z, edits)], 1)
                size = (found != 0).sum(1)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(short(found[found != 0])))
                yield pa.RecordBatch.from_arrays([pa.array(ids[i + doc]), pa.array(number), pa.array(signed(h)), lists], ["doc_id", "line", "h", "pieces"])

    return tidy(run)


def line_variants(words: np.ndarray, a: np.ndarray, z: np.ndarray, edits: int):
    """Of lines (word ranges) with up to ``edits`` words deleted: line, key, deletions, deleted places (-1: none)."""
    pw, inv = powers(len(words) + 3)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * pw[: len(words)])))  # of the words before each place
    n = z - a
    line = np.repeat(np.arange(len(a)), n + 1)
    p = np.arange(len(line)) - np.repeat(np.cumsum(n + 1) - n, n + 1)  # -1: the line itself
    part = lambda r, s, e, left: (sums[e] - sums[s]) * inv[a[r] + left]  # noqa: E731  a run of words, moved to the left
    size = n[line].astype(np.uint64)
    key = np.where(p < 0, part(line, a[line], z[line], 0) + size, part(line, a[line], a[line] + np.maximum(p, 0), 0) + part(line, a[line] + p + 1, z[line], 1) + size - np.uint64(1))
    out = [(line, mix(key), (p >= 0).astype(np.int8), p, np.full(len(p), -1))]
    if edits > 1:
        for r in range(len(a)):
            x, y = np.triu_indices(n[r], 1)
            key = part(r, a[r], a[r] + x, 0) + part(r, a[r] + x + 1, a[r] + y, 1) + part(r, a[r] + y + 1, z[r], 2) + np.uint64(n[r]) - np.uint64(2)
            out.append((np.full(len(x), r), mix(key), np.full(len(x), 2, np.int8), x, y))
    line, key, gone, p, q = (np.concatenate(c) for c in zip(*out, strict=True))
    return line, key, gone, p.astype(np.int32), q.astype(np.int32)


def _emit_variants(min_words: int, edits: int):
    """Variants of the listed lines: key, second hash, deletions, places, doc_id, line."""

    def run(batches):
        for b in batches:
            ids = np.array(b.column(0))
            wanted = [set(x.as_py()) for x in b.column(2)]
            for i, _, block in blocks(b, lower=True):
                doc, number, a, z, h = _line_rows(block, min_words)
                at = np.flatnonzero([x in wanted[i + d] for d, x in zip(doc.tolist(), signed(h).tolist(), strict=True)])
                while len(at):  # as many lines as make a bounded number of variants
                    few = max(1, int(np.searchsorted(np.cumsum(((z - a)[at] + 1.0) ** edits), VARIANTS)))
                    now, at = at[:few], at[few:]
                    line, key, gone, p, q = line_variants(block.words, a[now], z[now], edits)
                    check = line_variants(mix(block.words + _SECOND), a[now], z[now], edits)[1]
                    r = now[line]
                    cols = [signed(key), short(check), gone, p, q, ids[i + doc[r]], number[r]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "check", "gone", "p", "q", "doc_id", "line"])

    return tidy(run)


def near_keys(variants: DataFrame, edits: int) -> tuple[DataFrame, list[DataFrame]]:
    """(at, first): the least line that each line's variants prove to be within ``edits`` edits; and the stored tables it reads.

    One edit: one deletion at one place (substitution); a whole line against one deletion (insertion).
    Two: also one deletion each at any places, one whole line against two deletions, two deletions each at the
    same places, and two against one where one of the two places is the other line's (p, or q - 1 after p's insertion).
    """
    both = ["key", "check"]
    least = lambda k: F.min(F.when(F.col("gone") == k, F.col("at"))).alias(f"m{k}")
    found = []

    def meet(rows: DataFrame, on: list[str], per: list, choose, keep: str) -> None:
        firsts = store(rows.groupBy(*on).agg(*per, F.count(F.lit(1)).alias("c")).where("c > 1").where(keep).drop("c"), "firsts")
        found.append(firsts)
        metas.append(rows.join(firsts, on).select("at", choose.alias("first")))

    metas: list[DataFrame] = []
    if edits == 1:
        meet(variants.where("gone = 1"), [*both, "p"], [F.min("at").alias("m")], F.col("m"), "m is not null")
        meet(variants, both, [least(0), least(1)], F.when(F.col("gone") == 0, F.col("m1")).otherwise(F.col("m0")), "m0 is not null and m1 is not null")
    else:
        near = F.when(F.col("gone") == 0, F.least("m1", "m2")).when(F.col("gone") == 1, F.least("m0", "m1")).otherwise(F.col("m0"))
        meet(variants, both, [least(0), least(1), least(2)], near, "m1 is not null or m0 is not null")
        meet(variants.where("gone = 2"), [*both, "p", "q"], [F.min("at").alias("m")], F.col("m"), "m is not null")
        one = variants.where("gone = 1").withColumn("s", F.col("p"))
        two = variants.where("gone = 2").withColumn("s", F.explode(F.array_distinct(F.array(F.col("p"), F.col("q") - 1))))
        meet(one.union(two), [*both, "s"], [least(1), least(2)], F.when(F.col("gone") == 1, F.col("m2")).otherwise(F.col("m1")), "m1 is not null and m2 is not null")
    out = metas[0]
    for x in metas[1:]:
        out = out.union(x)
    return out.where("first < at").groupBy("at").agg(F.min("first").alias("first")), found


def _listed(docs: DataFrame, lines: DataFrame, item: str) -> DataFrame:
    """``docs`` with the list of ``item`` of their ``lines``; others are left out.  Broadcast only behind a count."""
    lists = lines.groupBy("doc_id").agg(F.collect_set(item).alias("wanted"))
    if lines.limit(BROADCAST_KEYS // 4 + 1).count() <= BROADCAST_KEYS // 4:
        lists = F.broadcast(lists)
    return docs.join(lists, "doc_id").select("doc_id", "text", "wanted")


def removable_lines(docs: DataFrame, min_words: int = MIN_WORDS, exact_words: int | None = None, edits: int = EDITS) -> DataFrame:
    """(doc_id, line, h, near) of every line occurrence that an equal or near line precedes."""
    exact_words = min_words if exact_words is None else exact_words
    lines = store(docs.mapInArrow(_emit_lines(min_words, exact_words, edits), "doc_id long, line int, h long, pieces array<int>"), "lines")
    key = F.struct("doc_id", "line").alias("key")
    firsts = store(lines.groupBy("h").agg(F.min(key).alias("key"), F.first("pieces").alias("pieces")), "firsts")
    again = lines.select("doc_id", "line", "h").join(firsts.select("h", "key"), "h").where(F.struct("doc_id", "line") != F.col("key"))
    again = store(again.select("doc_id", "line", "h", F.lit(False).alias("near")), "again")
    drop(lines)
    piece = firsts.select("h", F.explode("pieces").alias("b"))
    shared = store(piece.groupBy("b").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("b"), "shared")
    candidates = piece.join(shared, "b").select("h").distinct()
    near = store(firsts.select("h", "key").join(candidates, "h").select("key.doc_id", "key.line", "h"), "candidates")
    drop(shared, firsts)
    variants = _listed(docs, near, "h").mapInArrow(_emit_variants(min_words, edits), "key long, check int, gone tinyint, p int, q int, doc_id long, line int")
    variants = variants.join(near.select("doc_id", "line"), ["doc_id", "line"], "left_semi")
    variants = store(variants.select("key", "check", "gone", "p", "q", F.struct("doc_id", "line").alias("at")), "variants")
    flagged, read = near_keys(variants, edits)
    first = flagged.select("at.doc_id", "at.line").join(near, ["doc_id", "line"]).select("doc_id", "line", "h", F.lit(True).alias("near"))
    first = store(first, "flagged")
    drop(near, variants, *read)
    return again.union(first)


def _apply(min_words: int, columns: list[str]):
    """Rows (struct), their text and the lines to take out: the row's columns with the text that is left, n_removed and n_near."""

    def run(batches):
        for b in batches:
            row, text, gone = b.column(0), b.column(1), b.column(2)
            hit = np.flatnonzero(np.array(gone.is_valid()))
            left, removed, nearly = [], np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            part = pa.RecordBatch.from_arrays([text.take(pa.array(hit))], ["text"])
            for i, _, block in blocks(part, lower=True):
                doc, number, _, _, h = _line_rows(block, min_words)
                at = np.searchsorted(doc, np.arange(block.n + 1))
                for d in range(block.n):
                    r = int(hit[i + d])
                    listed = {(x["line"], x["h"]): x["near"] for x in gone[r].as_py()}
                    s = slice(at[d], at[d + 1])
                    cut = {int(n): listed[int(n), int(x)] for n, x in zip(number[s], signed(h[s]), strict=True) if (int(n), int(x)) in listed}
                    removed[r], nearly[r] = len(cut), sum(cut.values())
                    left.append("\n".join(x for n, x in enumerate(text[r].as_py().split("\n")) if n not in cut))
            if left:
                text = pc.replace_with_mask(text, gone.is_valid(), pa.array(left, pa.string()))
            fields = dict(zip([f.name for f in row.type], row.flatten(), strict=True)) | {"text": text, "n_removed": pa.array(removed), "n_near": pa.array(nearly)}
            yield pa.RecordBatch.from_arrays([fields[c] for c in columns], columns)

    return tidy(run)


def line_dedup(documents: DataFrame, min_words: int = MIN_WORDS, exact_words: int | None = None, edits: int = EDITS) -> DataFrame:
    """``documents`` with the later equal and near lines taken out of ``text``, and n_removed and n_near added.

    Near lines are sought among those of ``min_words`` words or more, equal ones among those of
    ``exact_words`` (``min_words`` if not given; 1: all lines but blank ones).  ``edits`` is 1 or 2; a line of n
    words has n + 1 variants with 1, about n * n / 2 with 2.

    All other columns stay as they are, whatever their names; columns named n_removed or n_near are replaced.  Null and
    blank texts stay, an empty table gives no rows; a document may end up with an empty text, one long line is one line.
    Of equal or near lines the first in the order (doc_id, line) stays.  Rows of one doc_id and text count as
    one document and share its fate; rows of one doc_id and different texts lose the lines that their id has to lose
    where they stand in the row's own text.  Rows without a doc_id are kept whole and are not compared.
    """
    if edits not in (1, 2):
        raise ValueError("edits must be 1 or 2")
    small_batches(documents.sparkSession)
    names = [c for c in documents.columns if c not in ("n_removed", "n_near")]
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    gone = removable_lines(docs, min_words, exact_words, edits).groupBy(F.col("doc_id").alias("gone_id"))
    gone = gone.agg(F.collect_set(F.struct("line", "h", "near")).alias("gone"))
    rows = documents.select(F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in names if c != "text")).alias("row"), F.col("text").cast("string").alias("row_text"), F.col("doc_id").cast("long").alias("row_id"))
    joined = rows.join(gone, F.col("row_id") == F.col("gone_id"), "left").select("row", "row_text", "gone")
    kinds = {f.name: f.dataType.simpleString() for f in joined.schema["row"].dataType.fields} | {"text": "string", "n_removed": "bigint", "n_near": "bigint"}
    columns = [*names, "n_removed", "n_near"]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    return joined.mapInArrow(_apply(min_words if exact_words is None else min(min_words, exact_words), columns), schema)
