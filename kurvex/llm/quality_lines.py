"""Document quality: per-text statistics, then cross-document line frequency per host.

Normalised lines (lower-case words, white space collapsed) are hashed; on each host (``source``)
the documents that hold a line are counted, each once.  Lines above the limit are removed, and a
document that keeps less than ``left_percent`` of its words, or fewer than ``least_left`` words, is rejected as depleted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import BROADCAST_KEYS, small_batches, store, tidy
from .textblocks import Block, blocks, mix, powers, signed, span_hash

#: A line is common when more than SHARE of the host's documents hold it, and more than MIN_DOCUMENTS; least share (in percent) and number of words to keep.
MIN_DOCUMENTS, SHARE, LEFT_PERCENT, LEAST_LEFT = 3, 0.01, 80, 50
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

_ROW = "doc_id long, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<int>"


def run_hash(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each run of words, whatever their place."""
    pw, inv = powers(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * pw[: len(words)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(np.uint64))


def lines_of(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each line with a word: document, byte start and end, first word and end word."""
    cut = np.flatnonzero(block.buf == 10)
    start = np.union1d(block.off[:-1][np.diff(block.off) > 0], cut + 1)
    start = start[start < len(block.buf)]
    doc = np.searchsorted(block.off, start, "right") - 1
    nxt = np.append(cut, len(block.buf))
    end = np.minimum(nxt[np.searchsorted(cut, start)], block.off[doc + 1])
    a, z = np.searchsorted(block.ws, start), np.searchsorted(block.ws, end)
    ok = z > a
    return doc[ok], start[ok], end[ok], a[ok], z[ok]


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value seen at an earlier index, value found twice or more) of each key."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = k[1:] == k[:-1]
    later, many = np.zeros(len(k), bool), np.zeros(len(k), bool)
    later[order[1:]] = same
    many[order[1:]] |= same
    many[order[:-1]] |= same
    return later, many


def per_doc(block: Block, flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` over the ranges that start and end at ``at``."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[at])


@tidy
def _measure(batches):
    for b in batches:
        for i, j, block in blocks(b):
            n_words = np.diff(block.first)
            inside = np.zeros(len(block.buf) + 1, np.int8)
            inside[block.ws] += 1
            np.subtract.at(inside, block.we, 1)
            chars = (np.cumsum(inside[:-1]) > 0) & ((block.buf & 0xC0) != 0x80)
            doc, start, end, a, z = lines_of(block)
            salt = mix(np.arange(block.n, dtype=np.uint64) + np.uint64(77))
            later, _ = repeats(span_hash(block.buf, start, end) + salt[doc])
            line_at = np.searchsorted(doc, np.arange(block.n + 1))
            h, at = block.windows(3)
            _, many = repeats(h + salt[block.doc_of_word()[at]] if len(at) else h)
            covered = np.zeros(len(block.ws) + 2, bool)
            for k in range(3):
                covered[at[many] + k] = True
            low = Block(block.buf, block.off, lower=True)
            norm = run_hash(low.words, a, z)
            lines, words = [], []
            for d in range(block.n):
                s = slice(line_at[d], line_at[d + 1])
                u, inv = np.unique(norm[s], return_inverse=True)
                lines.append(signed(u))
                words.append(np.bincount(inv, (z - a)[s], len(u)).astype(np.int32))
            cols = [
                n_words, per_doc(block, chars, block.off), per_doc(block, _SYMBOL[block.buf], block.off),
                per_doc(block, later, line_at), per_doc(block, covered[: len(block.ws)], block.first),
            ]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), *(pa.array(c.astype(np.int64)) for c in cols), pa.array(lines, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int32()))],
                ["doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words"],
            )


def quality_rules(documents: DataFrame, min_documents: int = MIN_DOCUMENTS, share: float = SHARE, left_percent: float = LEFT_PERCENT, least_left: int = LEAST_LEFT) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words, kept.

    A line is common on a host when more than ``share`` of the host's documents hold it, and more than
    ``min_documents`` of them, so the rule is the same on small and large hosts.  A document whose common lines leave
    less than ``left_percent`` of its words, or fewer than ``least_left`` words, is depleted and rejected; one that keeps exactly so much stays.

    Null, empty and blank texts have no words and fail; a null host is a host of its own; an empty table gives no rows.
    Every row is a document of its own, rows of one or of no doc_id too; a line counts once for each, however often it
    holds it.  Other columns are ignored, whatever their names; a long text is measured whole.
    """
    small_batches(documents.sparkSession)
    docs = documents.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", "coalesce(cast(source as string), '') source")
    rows = store(docs.mapInArrow(_measure, _ROW).withColumn("row", F.monotonically_increasing_id()), "lines")
    limit = rows.groupBy("source").agg(F.greatest(F.lit(float(min_documents)), F.count(F.lit(1)) * F.lit(share)).alias("limit"))
    found = rows.select("source", F.explode("lines").alias("line")).groupBy("source", "line").agg(F.count(F.lit(1)).alias("held"))
    common = store(found.where(F.col("held") > min_documents).join(limit, "source").where("held > limit").select("source", "line"), "common")
    if common.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        common = F.broadcast(common)
    lost = rows.select("row", "source", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("row", "source", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    lost = lost.join(common, ["source", "line"]).groupBy("row").agg(F.sum("words").alias("removed_words"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = rows.drop("lines", "line_words", "source").join(lost, "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
    out = out.withColumn("base_failed", base)
    left = F.col("n_words") - F.col("removed_words")
    kept = ~F.col("base_failed") & (100 * left >= F.lit(left_percent) * F.col("n_words")) & (left >= least_left)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", kept.alias("kept"))
