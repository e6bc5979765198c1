"""Bigram language model by deleted interpolation, with counts that grow with the corpus.

P(w|h) = a2[b] c(hw)/c(h) + a1[b] c(w)/N + a0[b]/(V+1), b the bucket of the context's frequency; contexts that were
never seen are a bucket of their own, where a2 is 0 and the other two add up to 1.
Documents are dealt into chunks by hash.  Every chunk sends its distinct n-gram keys, sorted and
packed, to the reducers of their key ranges; these add up the counts of all chunks and send the totals
back to the chunks in the order of the keys, so no table of counts is ever broadcast and no row
per token is shuffled.  The weights are learned by expectation-maximisation on all training documents,
each held out of the counts in turn (its own occurrences are deleted).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import small_batches, store, tidy
from .textblocks import _LANES, blocks, mix

#: Text bytes of a chunk, chunks to a key range, resolution of EM cells per octave.
CHUNK_BYTES, CHUNKS_PER_RANGE, CELLS = 2 << 20, 4, 4
_START, _END = np.uint64(0x51A2), np.uint64(0xE4D)
_BITS = {1: 64, 2: 48}


def pack(values: np.ndarray) -> bytes:
    """Byte planes of unsigned integers, the high ones left out while empty."""
    v = values.astype("<u8")
    width = max(1, (int(v.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    width = raw[0]
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel().astype(np.uint64)


@dataclass
class Chunk:
    """Tokens of whole documents in order, an end token after each, and their sorted distinct keys."""

    ids: list
    first: np.ndarray  # token range of each document
    keys: dict[int, np.ndarray]
    at: dict[int, np.ndarray]

    @classmethod
    def of(cls, table: pa.Table) -> Chunk:
        """Documents in the order of doc_id and text, so that a chunk's keys do not hang on the order of rows."""
        ids, parts, sizes = table.column("doc_id").to_pylist(), [], [np.zeros(1, np.int64)]
        for b in table.select(["text"]).combine_chunks().to_batches():
            for _, _, block in blocks(b, lower=True):
                w = np.insert(block.words, block.first[1:], _END)
                parts.append(w)
                sizes.append(np.diff(block.first) + 1)
        tokens = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        first = np.cumsum(np.concatenate(sizes))
        before = np.concatenate(([_START], tokens[:-1])) if len(tokens) else tokens
        before[first[:-1]] = _START
        key = {1: mix(tokens ^ np.uint64(0x1F)), 2: mix(before * _LANES[0] + tokens * _LANES[1]) >> np.uint64(16)}
        both = {n: np.unique(k, return_inverse=True) for n, k in key.items()}
        return cls(ids, first, {n: u for n, (u, _) in both.items()}, {n: i for n, (_, i) in both.items()})

    def local(self, n: int, train: np.ndarray) -> np.ndarray:
        """Occurrences of each key in the training documents of the chunk."""
        mask = np.repeat(train, np.diff(self.first))
        return np.bincount(self.at[n], mask, len(self.keys[n])).astype(np.int64)

    def cuts(self, n: int, ranges: int) -> np.ndarray:
        """Where the key ranges start in the sorted keys."""
        top = 1 << _BITS[n]
        return np.searchsorted(self.keys[n], np.array([(top * r + ranges - 1) // ranges for r in range(ranges)], np.uint64)).tolist() + [len(self.keys[n])]


def _requests(ranges: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        c = Chunk.of(table)
        train = np.array(table.column("train").to_pylist(), bool)
        rows = []
        for n in (1, 2):
            count, cuts = c.local(n, train), c.cuts(n, ranges)
            for r in range(ranges):
                k = c.keys[n][cuts[r] : cuts[r + 1]]
                if len(k):
                    rows.append((key[0].as_py(), n, r, pack(np.diff(k, prepend=np.uint64(0))), pack(count[cuts[r] : cuts[r + 1]])))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        return pa.table([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["chunk", "n", "r", "keys", "counts"])

    return tidy(run)


@tidy
def _totals(key: tuple, table: pa.Table) -> pa.Table:
    """Of one key range: what other chunks add to each chunk's counts; and a row with the range's distinct keys and tokens."""
    chunks = table.column("chunk").to_pylist()
    keys = [np.cumsum(unpack(k.as_py()), dtype=np.uint64) for k in table.column("keys")]
    counts = [unpack(k.as_py()).astype(np.int64) for k in table.column("counts")]
    u, inv = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inv, np.concatenate(counts), len(u)).astype(np.int64)
    more = np.split(total[inv] - np.concatenate(counts), np.cumsum([len(k) for k in keys])[:-1])
    n, r = key[0].as_py(), key[1].as_py()
    rows = [(c, n, r, pack(m), 0, 0) for c, m in zip(chunks, more, strict=True)]
    rows.append((-1, n, r, b"", int((total > 0).sum()), int(total.sum())))
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
    return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["chunk", "n", "r", "more", "distinct", "tokens"])


class _Counts:
    """Counts of each token of a chunk: of the token, of its context and of both."""

    def __init__(self, docs: pa.Table, replies: pa.Table, starts: int, own_out: bool = False):
        docs = docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.c = c = Chunk.of(docs)
        self.train = np.array(docs.column("train").to_pylist(), bool)
        replies = replies.sort_by([("n", "ascending"), ("r", "ascending")])
        got: dict[int, list] = {1: [], 2: []}
        for n, m in zip(replies.column("n").to_pylist(), replies.column("more"), strict=True):
            got[n].append(unpack(m.as_py()).astype(np.int64))
        per = {}
        for n in (1, 2):
            total = c.local(n, self.train) + (np.concatenate(got[n]) if got[n] else 0)
            per[n] = total[c.at[n]]
            if own_out:  # without the document's own occurrences
                doc = np.repeat(np.arange(len(c.ids)), np.diff(c.first))
                _, inv, own = np.unique(c.at[n].astype(np.int64) * len(c.ids) + doc, return_inverse=True, return_counts=True)
                per[n] = per[n] - own[inv] * self.train[doc]
        self.word, self.pair = per[1], per[2]
        self.context = np.concatenate(([0], self.word[:-1])) if len(self.word) else self.word
        self.context[c.first[:-1]] = starts - (1 if own_out else 0)


@dataclass
class Mixture:
    """Counts of the training corpus and the weights (pair, word, uniform) of each context-frequency bucket."""

    tokens: int
    distinct: int
    starts: int
    weights: np.ndarray

    @staticmethod
    def bucket(context: np.ndarray) -> np.ndarray:
        return np.log2(context + 1.0).astype(np.int64).clip(0, 40)

    def parts(self, c: _Counts) -> tuple[np.ndarray, np.ndarray, float]:
        return c.pair / np.maximum(c.context, 1), c.word / max(1, self.tokens), 1 / (self.distinct + 1)


def _cells(mix_: Mixture):
    """How often each cell (bucket, log-ratio of pair to uniform, of word to uniform) occurs among deleted training tokens."""

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        out: dict = {"b": [], "p": [], "w": [], "n": []}
        if docs.num_rows:
            c = _Counts(docs, replies, mix_.starts, own_out=True)
            p2, p1, p0 = mix_.parts(c)
            level = lambda p: np.where(p > 0, np.round(CELLS * np.log2(np.maximum(p, 1e-300) / p0)) + 1000, 0).astype(np.int64)
            keep = np.repeat(c.train, np.diff(c.c.first))
            cell = np.stack((Mixture.bucket(c.context), level(p2), level(p1)), 1)[keep]
            u, n = np.unique(cell, axis=0, return_counts=True)
            out = {"b": u[:, 0], "p": u[:, 1], "w": u[:, 2], "n": n}
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return tidy(run)


def normalised(weights: np.ndarray) -> np.ndarray:
    """Weights that add up to 1 in each bucket; bucket 0 holds the contexts that were never seen, where no pair has a share."""
    weights = weights.copy()
    weights[0, 0] = 0
    return weights / weights.sum(1, keepdims=True)


def start_weights() -> np.ndarray:
    return normalised(np.tile([0.4, 0.5, 0.1], (41, 1)))


def learn_weights(cells: pd.DataFrame, steps: int = 60) -> np.ndarray:
    """Mixture weights of each bucket by expectation-maximisation on counted cells; pseudo-counts from all buckets smooth rare ones."""
    b, n = cells["b"].to_numpy(), cells["n"].to_numpy(float)
    ratio = lambda x: np.where(x > 0, 2.0 ** ((x - 1000) / CELLS), 0.0)
    like = np.stack((ratio(cells["p"].to_numpy()), ratio(cells["w"].to_numpy()), np.ones(len(b))), 1)
    weights = start_weights()
    for _ in range(steps):
        post = weights[b] * like
        post *= (n / post.sum(1))[:, None]
        total = np.zeros((41, 3))
        np.add.at(total, b, post)
        if total.sum() == 0:
            break
        every = (total.sum(0) + 1e-3) / (total.sum(0) + 1e-3).sum()
        weights = normalised(total + 20 * every)
    return weights


def _scores(mix_: Mixture):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        ids, cols = [], [[] for _ in range(5)]
        if docs.num_rows:
            c = _Counts(docs, replies, mix_.starts)
            p2, p1, p0 = mix_.parts(c)
            a = mix_.weights[Mixture.bucket(c.context)]
            score = np.log10(a[:, 0] * p2 + a[:, 1] * p1 + a[:, 2] * p0)
            base = np.log10((c.word + 1) / (mix_.tokens + mix_.distinct + 1))
            at = c.c.first[:-1]
            ids = c.c.ids
            cols = [~c.train, np.diff(c.c.first), np.add.reduceat(c.word > 0, at, dtype=np.int64), np.add.reduceat(base, at), np.add.reduceat(score, at)]
        kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([pa.array(ids, pa.int64()), *(pa.array(x, t) for x, t in zip(cols, kinds, strict=True))], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return tidy(run)


def lm_scores(documents: DataFrame, held_out: Column) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    Counts are of the rows where ``held_out`` is false (null: held out).  Null texts are empty: one end token.
    Repeated rows, rows of one doc_id and rows without one are documents of their own and count as often as they occur.
    An empty table gives no rows; without training rows all is uniform.  Other columns are ignored, whatever their names;
    a long text is scored whole, in one chunk.
    """
    small_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(~held_out, F.lit(False)).alias("train"))
    size = docs.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    chunks = int(max(1, -(-size // CHUNK_BYTES)))
    docs = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    asked = docs.groupBy("chunk").applyInArrow(_requests(-(-chunks // CHUNKS_PER_RANGE)), "chunk long, n int, r int, keys binary, counts binary")
    told = store(asked.groupBy("n", "r").applyInArrow(_totals, "chunk long, n int, r int, more binary, distinct long, tokens long"), "totals")
    sums = {x.n: x for x in told.where("chunk < 0").groupBy("n").agg(F.sum("distinct").alias("distinct"), F.sum("tokens").alias("tokens")).collect()}
    starts = docs.where("train").count()
    mixture = Mixture(sums[1].tokens if sums else 0, sums[1].distinct if sums else 0, starts, start_weights())
    replies = told.where("chunk >= 0").select("chunk", "n", "r", "more")
    cells = docs.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_cells(mixture), "b long, p long, w long, n long")
    cells = cells.groupBy("b", "p", "w").agg(F.sum("n").alias("n")).toPandas()
    if len(cells):
        mixture.weights = learn_weights(cells)
    out = docs.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_scores(mixture), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(mixture.tokens).cast("long").alias("train_tokens"), "base_score", "score")
