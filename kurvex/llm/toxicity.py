"""Toxic passages by maximum-scoring segment search over token log-odds.

Tokens are lower-case words without outer punctuation; a token scores the significant log-odds, of either
sign (informative Dirichlet prior), of its word or else of its first bytes, and every other token a small
loss.  All maximal scoring segments of a text are found in linear time.  Extreme-value (Gumbel) fits to clean
documents tell how often their best segment, and the sum of their segments, gets as high by chance in a text of
as many tokens: a segment beyond ``ALPHA`` is a significant passage, and the sum's statistic gives the score after a
logistic step to labels.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import small_batches, store, tidy
from .textblocks import Block, blocks, mix, signed, span_hash

#: Bound of the labelled sample that is fitted (documents); it also bounds the significant features that the driver gets.
SAMPLE = 20_000
#: Chance that a clean text has a passage as high as one that counts as significant, and tokens added to a text's length.
ALPHA, EXTRA = 0.05, 50
#: Strength of the prior (pseudo-counts) and least significance of a feature, in standard deviations.
PRIOR, Z = 500.0, 3.5
PREFIXES = (4, 5)

_PUNCT = np.zeros(256, bool)
_PUNCT[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True


def cores(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word without its outer ASCII punctuation (words of punctuation alone stay)."""
    if not len(block.ws):
        return block.ws, block.we
    inner = np.flatnonzero(~_PUNCT[block.buf])
    first = np.append(inner, len(block.buf))[np.searchsorted(inner, block.ws)]
    last = np.insert(inner, 0, -1)[np.searchsorted(inner, block.we)]
    empty = first >= block.we  # nothing but punctuation
    return np.where(empty, block.ws, first), np.where(empty, block.we, last + 1)


def features(block: Block) -> list[np.ndarray]:
    """Hashes of each word's core and of its prefixes (0 where it is no longer than the prefix)."""
    if not len(block.ws):
        return [np.zeros(0, np.uint64)] * (1 + len(PREFIXES))
    start, end = cores(block)
    out = [span_hash(block.buf, start, end)]
    for p in PREFIXES:
        long = end - start > p
        h = mix(span_hash(block.buf, start, np.minimum(start + p, end)) + np.uint64(p))
        out.append(np.where(long, h, np.uint64(0)))
    return out


@dataclass
class ToxicModel:
    """Sorted feature hashes with weights, the loss of other tokens, and the calibration."""

    keys: np.ndarray
    weights: np.ndarray
    loss: float
    gumbel: tuple[float, float] = (0.0, 1.0)  # of the sum of a text's segments
    passage: tuple[float, float] = (0.0, 1.0)  # of its best segment
    logit: tuple[float, float] = (0.0, 1.0)

    def token_scores(self, block: Block) -> np.ndarray:
        score = np.full(len(block.ws), -self.loss)
        if len(self.keys) and len(score):
            for h in reversed(features(block)):  # a word's own weight goes before its prefixes'
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                hit = (self.keys[at] == h) & (h != 0)
                score[hit] = self.weights[at[hit]]
        return score

    @staticmethod
    def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
        """All maximal scoring segments (first, end, sum) of one text's token scores, in linear time.

        ``open_`` has the candidates (first, end, total before, total at the end) with the place of the last one before
        that starts lower: what stands between starts no lower and is passed over.
        """
        total = np.concatenate(([0.0], np.cumsum(score))).tolist()
        done: list[tuple] = []
        open_: list[tuple] = []
        for i in np.flatnonzero(score > 0).tolist():
            first, low, high = i, total[i], total[i + 1]
            j = len(open_) - 1
            while True:
                while j >= 0 and open_[j][2] >= low:
                    j = open_[j][4]
                if j < 0:  # nothing before can grow any more
                    done += open_
                    open_ = [(first, i + 1, low, high, -1)]
                    break
                if open_[j][3] >= high:
                    open_.append((first, i + 1, low, high, j))
                    break
                first, low = open_[j][0], open_[j][2]
                del open_[j:]
                j = len(open_) - 1
        return [(a, z, high - low) for a, z, low, high, _ in done + open_]

    def chance(self, best: float, n: int) -> float:
        """Chance that a clean text of n tokens has a segment that scores as high."""
        mu, beta = self.passage
        return float(-np.expm1(-(n + EXTRA) * np.exp(np.clip((mu - best) / beta, -700, 50))))

    def raw(self, total: float, n: int) -> float:
        """Extreme-value statistic: the segments' sum less what a clean text of n tokens reaches by chance."""
        mu, beta = self.gumbel
        return (total - mu) / beta - np.log(n + EXTRA)

    def score(self, raw: float) -> float:
        a, b = self.logit
        return float(1 / (1 + np.exp(-np.clip(a + b * raw, -50, 50))))


def _counts(batches):
    """(feature, toxic documents, clean documents) over a block's labelled documents."""
    for b in batches:
        label = np.array(b.column(2))
        for i, _, block in blocks(b, lower=True):
            toxic = label[i + block.doc_of_word()] == 1
            h = np.concatenate(features(block))
            salt = mix(block.doc_of_word().astype(np.uint64) + np.uint64(1))
            _, once = np.unique(h + np.tile(salt, 1 + len(PREFIXES)), return_index=True)  # a document counts once
            once = once[h[once] != 0]
            u, inv = np.unique(h[once], return_inverse=True)
            one = np.bincount(inv, np.tile(toxic, 1 + len(PREFIXES))[once], len(u)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signed(u)), pa.array(one), pa.array(np.bincount(inv, minlength=len(u)) - one)], ["h", "toxic", "clean"])


def _raws(model: ToxicModel):
    """(label, tokens, sum of segments, best segment) of each labelled document."""

    def run(batches):
        for b in batches:
            label = np.array(b.column(2))
            for i, _, block in blocks(b, lower=True):
                s = model.token_scores(block)
                rows = []
                for d in range(block.n):
                    found = [x[2] for x in model.segments(s[block.first[d] : block.first[d + 1]])]
                    rows.append((int(label[i + d]), float(block.first[d + 1] - block.first[d]), float(sum(found)), float(max(found, default=0.0))))
                kinds = (pa.int64(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["label", "n", "s", "best"])

    return tidy(run)


def weigh(counts: DataFrame, toxic_tokens: int, clean_tokens: int) -> ToxicModel:
    """Significant log-odds of features under a Dirichlet prior in proportion to their overall counts, in favour of either side.

    All of them reach the driver: there are at most as many as the bounded sample has distinct words and prefixes.
    """
    n = max(1, toxic_tokens + clean_tokens)
    a = F.lit(PRIOR) * (F.col("toxic") + F.col("clean")) / n
    p = lambda c, total: F.log((F.col(c) + a) / (F.lit(float(total) + PRIOR) - F.col(c) - a))
    odds = p("toxic", toxic_tokens) - p("clean", clean_tokens)
    q, both = toxic_tokens / n, F.col("toxic") + F.col("clean")
    part = lambda c, share: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (both * F.lit(max(share, 1e-9))))).otherwise(0.0)
    z = F.sqrt(F.greatest(F.lit(0.0), 2 * (part("toxic", q) + part("clean", 1 - q))))  # likelihood ratio against equal shares
    sides = "(toxic >= 3 and w > 1) or (clean >= 3 and w < -1)"
    best = counts.select("h", odds.alias("w"), z.alias("z"), "toxic", "clean").where(F.col("z") > Z).where(sides).collect()
    h = np.array([r.h for r in best], np.int64).view(np.uint64)
    w = np.array([r.w for r in best], float)
    order = np.argsort(h)
    share = lambda c, total: min(0.5, sum(r[c] for r in best if r.w > 0) / 3 / max(1, total))
    loss = np.log((1 - share("clean", clean_tokens)) / (1 - share("toxic", toxic_tokens)))
    return ToxicModel(h[order], w[order], float(max(loss, 0.005)))


def gumbel(highest: np.ndarray, size: np.ndarray) -> tuple[float, float]:
    """Location (for one token) and scale of Gumbel values whose location grows with the logarithm of the size, by moments."""
    beta = max(float(np.std(highest)) * np.sqrt(6) / np.pi, 0.5)
    return float(np.mean(highest - beta * np.log(size))) - 0.5772 * beta, beta


def fit_toxicity(labelled: DataFrame) -> ToxicModel:
    """Fits on rows (doc_id, text, toxic), bounded by ``labelled_sample``; two folds calibrate each other's weights."""
    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null")
    part = rows.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(2)))
    parts = part.mapInArrow(_fold_counts, "fold int, h long, toxic long, clean long").groupBy("fold", "h").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = store(parts, "toxic-counts")
    totals = {r.fold: (r.t, r.c) for r in counts.where("h = 0").select("fold", F.col("toxic").alias("t"), F.col("clean").alias("c")).collect()}
    counts = counts.where("h <> 0")
    t = [totals.get(k, (0, 0)) for k in (0, 1)]
    halves = [weigh(counts.where(F.col("fold") == k), *t[k]) for k in (0, 1)]
    got = [r for k in (0, 1) for r in part.where(F.col("fold") == 1 - k).select("doc_id", "text", "toxic").mapInArrow(_raws(halves[k]), "label long, n double, s double, best double").collect()]
    whole = counts.groupBy("h").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    model = weigh(whole, t[0][0] + t[1][0], t[0][1] + t[1][1])
    y, n, s, best = (np.array([r[c] for r in got], float) for c in ("label", "n", "s", "best"))
    if (y == 0).any():
        model.gumbel, model.passage = (gumbel(x[y == 0], n[y == 0] + EXTRA) for x in (s, best))
    if 0 < y.sum() < len(y):
        x = np.array([model.raw(v, k) for v, k in zip(s, n, strict=True)])
        model.logit = _logistic(x, y)
    else:
        model.logit = (-4.0 if not y.sum() else 4.0, 1e-3)
    return model


@tidy
def _fold_counts(batches):
    for b in batches:
        for fold in (0, 1):
            part = pa.Table.from_batches([b]).filter(pa.compute.equal(b.column(3), fold)).combine_chunks().to_batches()
            for p in part:
                label = np.array(p.column(2))
                total = [0, 0]
                for i, _, block in blocks(p, lower=True):
                    y = label[i + block.doc_of_word()]
                    total = [total[0] + int((y == 1).sum()), total[1] + int((y != 1).sum())]
                for c in _counts([p]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), fold, np.int32)), *c.columns], ["fold", "h", "toxic", "clean"])
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((fold, 0, *total), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["fold", "h", "toxic", "clean"])


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Two-parameter logistic regression by Newton steps, with a weak ridge; labels are smoothed slightly."""
    scale = max(float(np.std(x)), 1e-9)
    d = np.stack((np.ones_like(x), np.clip(x / scale, -20, 20)), 1)
    w = np.zeros(2)
    y = np.clip(y, 0.001, 0.999)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -50, 50)))
        g = d.T @ (y - p) - 1e-3 * w
        h = (d * (p * (1 - p))[:, None]).T @ d + np.eye(2) * 1e-3
        step = np.linalg.solve(h, g)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(w[1], 1e-6) / scale)


def _scored(model: ToxicModel, columns: list[str]):
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("chance", pa.float64())]))

    def run(batches):
        for b in batches:
            kept = dict(zip([f.name for f in b.column(1).type], b.column(1).flatten(), strict=True))
            for i, j, block in blocks(b, "_text", lower=True):
                s = model.token_scores(block)
                hit = np.searchsorted(np.flatnonzero(s > 0), block.first)
                score, spans = [], []
                for d in range(block.n):
                    a, z = int(block.first[d]), int(block.first[d + 1])
                    found = model.segments(s[a:z]) if hit[d] < hit[d + 1] else []
                    score.append(model.score(model.raw(sum(x[2] for x in found), z - a)))
                    rated = [(x, y, v, model.chance(v, z - a)) for x, y, v in found]
                    spans.append([{"first": x, "end": y, "score": float(v), "chance": p} for x, y, v, p in rated if p <= ALPHA])
                out = {c: x.slice(i, j - i) for c, x in kept.items()} | {"score": pa.array(score, pa.float64()), "passages": pa.array(spans, kind)}
                yield pa.RecordBatch.from_arrays([out[c] for c in columns], columns)

    return tidy(run)


def score_toxicity(documents: DataFrame, model: ToxicModel, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of every row with score (0 to 1) and passages (word range, score and chance of each significant segment).

    Null, empty and blank texts get the score of a text without hits.  No shuffle: rows are independent, repeated rows get
    the same result, texts are read whole.  A kept column named score or passages is replaced; other names can't clash.
    """
    small_batches(documents.sparkSession)
    kept = [c for c in keep if c not in ("score", "passages")]
    d = documents.select(F.col("text").cast("string").alias("_text"), F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in kept)).alias("_row"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema["_row"].dataType.fields[1:]]
    schema = ", ".join([*kinds, "score double", "passages array<struct<first: int, end: int, score: double, chance: double>>"])
    return d.mapInArrow(_scored(model, [*kept, "score", "passages"]), schema)


def labelled_sample(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` labelled documents (doc_id, text, toxic), by the least hash of doc_id; the ids are broadcast.

    A doc_id counts once: with its highest label and its least text.  Rows without doc_id or label are left out.
    """
    ids = labels.selectExpr("cast(doc_id as long) doc_id", "cast(toxic as int) toxic").where("doc_id is not null and toxic is not null")
    ids = ids.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found = documents.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
