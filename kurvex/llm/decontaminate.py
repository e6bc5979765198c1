"""Benchmark decontamination by template canonicalisation.

Words lose outer punctuation and case; numbers, names (capitalised inside a sentence) and units
(after a number) become typed placeholders.  Windows of template tokens are hash-joined with the
benchmark's; slots of matching windows must be consistent: along one alignment, equal values in the
item stand for equal values in the document.  Windows with few literals are compared by their exact
values.  A document is contaminated by an item when the consistent matches cover at least ``share`` of
the item's template windows or of all its windows; an item without a template window (short, or full of
placeholders) also when its whole text is found, as a template if it has enough literals, else exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_lines import run_hash
from .runtime import small_batches, store, tidy
from .textblocks import Block, blocks, mix, signed, span_hash
from .toxicity import cores

#: Words of a window, least words in it that are no placeholders, and share of an item's windows that must match.
WINDOW, LITERALS, SHARE = 8, 4, 0.5
#: Benchmark windows are looked up in slices of at most so many hashes (8 bytes each); each slice is one scan.
SLICE = 2_000_000

#: Units that follow a number.
UNITS = (
    "kg g mg lb lbs oz t km m cm mm mi ft in inch inches yd l ml s sec seconds min minutes h hours days weeks "
    "months years hz khz mhz ghz w kw v a c f k pct percent % usd eur dollars euros cents mph kmh bytes kb mb gb tb"
).split()
#: First byte and range of the second byte of capital letters with two bytes (Latin-1, Greek, Cyrillic).
CAPITALS = ((0xC3, 0x80, 0x9E), (0xCE, 0x86, 0x8F), (0xCE, 0x91, 0xAB), (0xD0, 0x80, 0xAF))
_NUMBER, _NAME, _UNIT = (np.uint64(0xA1), np.uint64(0xB2), np.uint64(0xC3))
_TEMPLATE, _EXACT = (np.uint64(0xD4), np.uint64(0xE5))


def _hash_list(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    off = np.cumsum([0, *map(len, raw)])
    return np.sort(span_hash(np.frombuffer(b"".join(raw), np.uint8), off[:-1], off[1:]))


def template(block: Block, low: Block) -> tuple[np.ndarray, np.ndarray]:
    """Template token and value hash of every word (``low``: the same block in lower case)."""
    if not len(block.ws):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    start, end = cores(block)
    value = span_hash(low.buf, start, end)
    digits = np.cumsum(np.append(0, (block.buf >= 48) & (block.buf <= 57)))
    number = digits[end] > digits[start]
    first = block.buf[start]
    second = block.buf[np.minimum(start + 1, len(block.buf) - 1)]
    upper = (first >= 65) & (first <= 90)
    for lead, lo, hi in CAPITALS:
        upper |= (first == lead) & (second >= lo) & (second <= hi)
    upper &= (first != 0xC3) | (second != 0x97)  # the multiplication sign stands among the capitals
    tail = block.buf[block.we - 1]
    opens = np.ones(len(start), bool)  # first word of a sentence, line or document
    lines = np.cumsum(np.append(0, block.buf == 10))
    opens[1:] = np.isin(tail[:-1], np.frombuffer(b".!?:", np.uint8)) | (lines[block.ws[1:]] > lines[block.we[:-1]])
    opens[block.first[:-1][np.diff(block.first) > 0]] = True
    units = _hash_list(UNITS)
    unit = np.zeros(len(start), bool)
    at = np.minimum(np.searchsorted(units, value), len(units) - 1)
    unit[1:] = (units[at][1:] == value[1:]) & number[:-1] & ~number[1:]
    token = value.copy()
    token[upper & ~opens & ~number] = _NAME
    token[unit] = _UNIT
    token[number] = _NUMBER
    return token, value


def _canonical(block: Block):
    """Template tokens and values of the words, values where a slot is and else zero, and the sums of literals before each word."""
    token, value = template(block, Block(block.buf, block.off, lower=True))
    slot = (token == _NUMBER) | (token == _NAME) | (token == _UNIT)
    return token, value, np.where(slot, value, np.uint64(0)), np.cumsum(np.append(0, ~slot))


def _starts(block: Block, size: int) -> np.ndarray:
    """First words of the windows of ``size`` words inside one document."""
    doc = block.doc_of_word()
    return np.flatnonzero(doc[: len(doc) - size + 1] == doc[size - 1 :]) if len(doc) >= size else np.zeros(0, np.int64)


def _hashes(token, value, at, size):
    """Template hash and exact hash of the windows that start at ``at``."""
    return mix(run_hash(token, at, at + size) + _TEMPLATE), mix(run_hash(value, at, at + size) + _EXACT)


def _batch(ids, at, kind, size, h, vals, key) -> pa.RecordBatch:
    """Rows of windows of one size."""
    slots = vals[at[:, None] + np.arange(size)]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, size * len(h) + 1, size, dtype=np.int32)), pa.array(signed(np.ascontiguousarray(slots)).ravel()))
    place, at = kind
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(at.astype(np.int64)), pa.array(place.astype(np.int32)), pa.array(signed(h)), lists], [key, "place", "kind", "h", "slots"])


def _item_windows(size: int, literals: int):
    """(item_id, place, kind, h, slots) of the items' windows.

    Kind 0: template of ``size`` words with enough literals; 1: window with fewer, by exact values; 2: the
    whole text of an item without a window of kind 0, by exact values and, with enough literals, as a template.
    """

    def run(batches):
        for b in batches:
            ids = np.array(b.column(0))
            for i, _, block in blocks(b):
                token, value, vals, lit = _canonical(block)
                at = _starts(block, size)
                t, x = _hashes(token, value, at, size)
                usable = lit[at + size] - lit[at] >= literals
                doc = np.searchsorted(block.first, at, "right") - 1
                if len(at):
                    yield _batch(ids[i + doc], at, (np.where(usable, 0, 1), at - block.first[doc]), size, np.where(usable, t, x), vals, "item_id")
                for d in np.setdiff1d(np.flatnonzero(np.diff(block.first)), doc[usable]):
                    n, at = int(block.first[d + 1] - block.first[d]), block.first[d : d + 1]
                    t, x = _hashes(token, value, at, n)
                    for h in [x, t][: 2 if lit[at[0] + n] - lit[at[0]] >= literals else 1]:
                        yield _batch(ids[i + d : i + d + 1], at, (np.full(1, 2), np.zeros(1, np.int64)), n, h, vals, "item_id")

    return tidy(run)


def _document_windows(size: int, literals: int, sizes: list[int], wanted: np.ndarray, exact: bool):
    """(doc_id, place, kind, h, slots) of the wanted windows, of ``size`` words (``exact``: by values too) and of the ``sizes`` of whole items."""

    def run(batches):
        for b in batches:
            ids = np.array(b.column(0))
            for i, _, block in blocks(b):
                token, value, vals, lit = _canonical(block)
                for n in sorted({size, *sizes}):
                    at = _starts(block, n)
                    t, x = _hashes(token, value, at, n)
                    both = [(t, lit[at + n] - lit[at] >= literals)] + [(x, True)] * (exact or n in sizes)
                    for h, ok in both:
                        k = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                        hit = np.flatnonzero((wanted[k] == h) & ok)
                        if len(hit):
                            doc = np.searchsorted(block.first, at[hit], "right") - 1
                            # documents without words share a boundary: the last of them holds the word
                            yield _batch(ids[i + doc], at[hit], (np.zeros(len(hit)), at[hit] - block.first[doc]), n, h[hit], vals, "doc_id")

    return tidy(run)


def contaminated(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, literals: int = LITERALS, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, matched, windows) of every document and item with enough consistent matches.

    Null, empty and blank texts match nothing; an item shorter than a window is one window; empty tables give no rows.
    Rows of one doc_id are one document, which is contaminated if a text of it is; rows without a doc_id or item_id are
    left out; of repeated items of one item_id the least text counts.  Items that tie each have a row.  Other columns are
    ignored, whatever their names; long texts are searched whole.
    """
    small_batches(documents.sparkSession)
    docs = documents.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").where("doc_id is not null")
    items = benchmark.selectExpr("cast(item_id as long) item_id", "cast(text as string) text").where("item_id is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    row = "place long, kind int, h long, slots array<long>"
    tests = store(items.mapInArrow(_item_windows(size, literals), f"item_id long, {row}"), "tests")
    n = tests.select("h").distinct().count()
    by_kind = [F.countDistinct(F.when(F.col("kind") == k, F.col("place"))) for k in range(3)]
    total = tests.groupBy("item_id").agg(by_kind[0].alias("templates"), by_kind[1].alias("exacts"))
    total = total.select("item_id", "templates", F.greatest(F.col("templates") + F.col("exacts"), F.lit(1)).alias("windows"))
    sizes = sorted(r.n for r in tests.where("kind = 2").select(F.size("slots").alias("n")).distinct().collect())
    exact = not tests.where("kind = 1").isEmpty()
    slices = max(1, -(-n // SLICE))
    hits = None
    for k in range(slices):
        part = tests.select("h").distinct().where(F.pmod("h", F.lit(slices)) == k)
        wanted = np.sort(np.array([r.h for r in part.toLocalIterator()], np.int64).view(np.uint64))
        if len(wanted):
            found = docs.mapInArrow(_document_windows(size, literals, sizes, wanted, exact), f"doc_id long, {row}").drop("kind")
            hits = found if hits is None else hits.union(found)
    if hits is None:
        return tests.select(F.col("item_id").alias("doc_id"), "item_id", F.lit(0).cast("long").alias("matched"), F.lit(0).cast("long").alias("windows")).where("false")
    both = hits.join(tests.toDF("item_id", "item_place", "kind", "h", "item_slots"), "h")
    both = store(both.select("doc_id", "item_id", (F.col("place") - F.col("item_place")).alias("shift"), "item_place", "kind", "slots", "item_slots").distinct(), "hits")
    at = ["doc_id", "item_id", "shift", "kind"]
    slots = both.select(*at, F.explode(F.arrays_zip("item_slots", "slots")).alias("s")).select(*at, F.col("s.item_slots").alias("a"), F.col("s.slots").alias("b")).where("a <> 0")
    clash = slots.groupBy(*at, "a").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).where("lo <> hi").select(*at).distinct()
    good = both.join(clash, at, "left_anti")
    places = [F.countDistinct(F.when(F.col("kind") == k, F.col("item_place"))) for k in range(2)]
    found = good.groupBy("doc_id", "item_id").agg(places[0].alias("t"), places[1].alias("x"), F.max(F.col("kind") == 2).alias("whole")).join(total, "item_id")
    found = found.withColumn("matched", F.when(F.col("whole"), F.col("windows")).otherwise(F.col("t") + F.col("x")))
    enough = (F.col("matched") >= F.col("windows") * F.lit(share)) | ((F.col("t") > 0) & (F.col("t") >= F.col("templates") * F.lit(share)))
    return found.where(enough).select("doc_id", "item_id", "matched", "windows")
