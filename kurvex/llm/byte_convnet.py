"""Language identification by a convolutional network over bytes.

Texts are cut into windows of a fixed number of UTF-8 bytes that overlap by one filter, so that every byte n-gram is
seen; bytes are embedded, filters of several widths slide over them, each filter keeps its maximum, and a
softmax over these maxima gives the languages of a window.  A text's languages are the means of its windows' probabilities,
weighted by their letters.  The network is trained in numpy on a bounded sample; applying it shuffles nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import small_batches, tidy
from .textblocks import text_buffers

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 16, 8
#: Bound of the training sample: documents in all, shared equally by the languages, but so many of each; windows of a document.
SAMPLE, LEAST, PER_DOCUMENT = 6000, 50, 4
#: Training: windows a step, bounds of the number of steps, passes over the windows between them, step length, weight decay.
BATCH, STEPS, EPOCHS, RATE, DECAY = 128, (300, 900), 6, 5e-3, 1e-4
#: Windows that are evaluated together.
CHUNK = 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class ByteNet:
    """Weights: ``embed`` (256, e), per width a filter matrix (width * e, f) with its bias, ``out`` (all filters, languages)."""

    languages: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.biases, self.out, self.out_bias]

    @property
    def widths(self) -> list[int]:
        return [len(w) // self.embed.shape[1] for w in self.filters]

    def taps(self) -> list[list[np.ndarray]]:
        """Per width and place in the filter: the responses to each byte.  A filter's response is the sum over its bytes."""
        e = self.embed.shape[1]
        return [[self.embed @ w[j * e : (j + 1) * e] for j in range(k)] for k, w in zip(self.widths, self.filters, strict=True)]

    def pair_tables(self) -> list[list[np.ndarray]]:
        """``taps`` of two neighbouring bytes each, in rows ``256 * first + second``; the last one of an odd width is single."""
        pairs = lambda t: [(t[j][:, None] + t[j + 1][None]).reshape(65536, -1) if j + 1 < len(t) else t[j] for j in range(0, len(t), 2)]
        return [pairs(t) for t in self.taps()]

    def softmax_of(self, tops: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Activations of all filters, given their greatest responses, and the languages' probabilities."""
        hidden = np.maximum(np.concatenate([t + b for t, b in zip(tops, self.biases, strict=True)], 1), 0)
        return hidden, softmax(hidden @ self.out + self.out_bias)

    def probabilities(self, windows: np.ndarray, tables: list[list[np.ndarray]] | None = None) -> np.ndarray:
        """Softmax over the languages of each window; places come first, so that a maximum over them runs along memory."""
        w = np.ascontiguousarray(windows.T)
        pair = (w[:-1].astype(np.intp) << 8) | w[1:]
        tops = []
        for k, t in zip(self.widths, tables or self.pair_tables(), strict=True):
            places = len(w) - k + 1
            response = None
            for j, table in enumerate(t):
                seen = table.take((pair if len(table) > 256 else w)[2 * j : 2 * j + places], 0)
                response = seen if response is None else np.add(response, seen, out=response)
            tops.append(response.max(0))
        return self.softmax_of(tops)[1]

    def gradients(self, windows: np.ndarray, language: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy of the windows and its gradient for each parameter; only the best place of a filter has one."""
        rows, places, best = np.arange(len(windows)), [], []
        for k, t in zip(self.widths, self.taps(), strict=True):
            response = sum(t[j].take(windows[:, j : windows.shape[1] - k + 1 + j], 0) for j in range(k))
            places.append(response.argmax(1))  # (windows, filters)
            best.append(np.take_along_axis(response, places[-1][:, None], 1)[:, 0])
        hidden, p = self.softmax_of(best)
        loss = float(-np.log(np.maximum(p[rows, language], 1e-12)).mean())
        p[rows, language] -= 1
        p /= len(windows)
        back = (p @ self.out.T) * (hidden > 0)
        d_embed, d_filters, d_biases, at = np.zeros_like(self.embed), [], [], 0
        for t, w, k in zip(places, self.filters, self.widths, strict=True):
            g = back[:, at : at + w.shape[1]]
            at += w.shape[1]
            seen = windows[rows[:, None, None], t[:, :, None] + np.arange(k)]  # bytes (windows, filters, width)
            d_filters.append(np.einsum("nf,nfke->kef", g, self.embed[seen]).reshape(w.shape))
            d_biases.append(g.sum(0))
            np.add.at(d_embed, seen, g[:, :, None, None] * w.T.reshape(1, w.shape[1], k, -1))
        return loss, [d_embed, *d_filters, *d_biases, hidden.T @ p, p.sum(0)]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def new_net(languages: list[str], seed: int = 1, window_widths=WIDTHS, filters: int = FILTERS, embed: int = EMBED, kind=np.float32) -> ByteNet:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(kind)
    n = filters * len(window_widths)
    return ByteNet(
        languages, draw(256, embed, scale=0.5), [draw(k * embed, filters, scale=(k * embed) ** -0.5) for k in window_widths],
        [np.zeros(filters, kind) for _ in window_widths], draw(n, len(languages), scale=n**-0.5), np.zeros(len(languages), kind),
    )


def train(windows: np.ndarray, language: np.ndarray, languages: list[str], seed: int = 1) -> ByteNet:
    """Adam on random batches; the same windows in the same order give the same network."""
    net, rng = new_net(languages, seed), np.random.default_rng(seed)
    steps = int(np.clip(EPOCHS * len(windows) / BATCH, *STEPS))
    first, second = ([np.zeros_like(p) for p in net.parameters()] for _ in range(2))
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(windows), BATCH)
        _, grads = net.gradients(windows[pick], language[pick])
        rate = RATE * min(1, 3 * (1 - (step - 1) / steps))  # constant, then down to zero
        for p, g, m, v in zip(net.parameters(), grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + DECAY * p)
    return net


def window_starts(off: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, first byte) of every window of texts with these byte offsets; an empty text has one."""
    n = np.maximum(-(-(np.diff(off) - (WINDOW - stride)) // stride), 1)
    text = np.repeat(np.arange(len(n)), n)
    return text, off[text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * stride


def cut(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The windows at ``start``, filled with zeros from ``end`` on."""
    at = start[:, None] + np.arange(WINDOW)
    inside = at < end[:, None]
    out = raw[np.where(inside, at, 0)] if len(raw) else np.zeros(at.shape, np.uint8)
    out[~inside] = 0
    return out


@tidy
def _samples(batches):
    for b in batches:
        raw, off = text_buffers(b.column(2))
        text, start = window_starts(off, WINDOW)
        first = np.searchsorted(text, np.arange(len(off)))
        kept = []
        for d, h in enumerate(b.column(1).to_pylist()):
            pick = first[d] + np.sort(np.random.default_rng(h % (1 << 32)).permutation(first[d + 1] - first[d])[:PER_DOCUMENT])
            kept.append(cut(raw, start[pick], np.full(len(pick), off[d + 1])).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(kept, pa.binary())], ["lang", "h", "windows"])


def fit_language_model(labelled: DataFrame, sample: int = SAMPLE, least: int = LEAST, seed: int = 1) -> ByteNet | None:
    """A network trained on rows (text, lang), of which about ``sample`` are used, the same number of each language.

    Rows are drawn by their texts' hashes, so equal texts count once; null texts and null languages are left out.
    At most ``2 * sample + 2 * least`` rows for each language reach the driver, as ``PER_DOCUMENT`` windows each.
    None if there is no labelled row.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.selectExpr("cast(lang as string) lang", "cast(text as string) text").where("lang is not null and text is not null and text <> ''")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    each = max(least, sample // len(counts))
    hashed = rows.select("lang", F.xxhash64("text", F.lit(seed)).alias("h"), "text")
    share = F.element_at(F.create_map(*(F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, each / n)))), F.col("lang"))
    drawn = hashed.where(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20)).mapInArrow(_samples, "lang string, h long, windows binary")
    got = drawn.groupBy("lang", "h").agg(F.first("windows").alias("windows")).orderBy("h", "lang").limit(2 * sample + 2 * least * len(counts)).collect()
    if not got:
        return None
    languages = sorted({r.lang for r in got})
    windows = [np.frombuffer(r.windows, np.uint8).reshape(-1, WINDOW) for r in got]
    language = np.repeat([languages.index(r.lang) for r in got], [len(w) for w in windows])
    return train(np.concatenate(windows), language, languages, seed)


def text_probabilities(net: ByteNet, raw: np.ndarray, off: np.ndarray, tables: list[list[np.ndarray]] | None = None) -> np.ndarray:
    """Languages of each text: means of its windows' probabilities, weighted by letter bytes."""
    stride, tables = WINDOW - max(net.widths) + 1, tables or net.pair_tables()
    text, start = window_starts(off, stride)
    sums, weights = np.zeros((len(off) - 1, len(net.languages))), np.zeros(len(off) - 1)
    for i in range(0, len(text), CHUNK):
        own = text[i : i + CHUNK]
        windows = cut(raw, start[i : i + CHUNK], off[own + 1])
        letters = _LETTER[windows].sum(1) + 1e-6
        np.add.at(sums, own, net.probabilities(windows, tables) * letters[:, None])
        np.add.at(weights, own, letters)
    return sums / weights[:, None]


def _predict(net: ByteNet, columns: list[str]):
    def run(batches):
        tables = net.pair_tables()
        for b in batches:
            kept = dict(zip([f.name for f in b.column(1).type], b.column(1).flatten(), strict=True))
            known = b.column(2).to_numpy(zero_copy_only=False)
            raw, off = text_buffers(b.column(0))
            p = text_probabilities(net, raw, off, tables)
            best = p.argmax(1)
            langs = [net.languages[k] if ok else "und" for k, ok in zip(best, known, strict=True)]
            score = np.where(known, np.clip(p[np.arange(len(p)), best], 0.0, 1.0), 0.0)
            out = kept | {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(score.astype(np.float64))}
            yield pa.RecordBatch.from_arrays([out[c] for c in columns], columns)

    return tidy(run)


def predict_language(documents: DataFrame, net: ByteNet | None, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of every row, with lang_pred and score (its probability); nothing but the text decides.

    ``und`` with a score of 0 stands for null texts, texts without a letter, and for every text if there is no network.
    Of equally probable languages the first in order is given.  Long texts are read whole, repeated rows get the
    same result; a kept column named lang_pred or score is replaced, other names can't clash; an empty table gives no rows.
    """
    small_batches(documents.sparkSession)
    kept = [c for c in keep if c not in ("lang_pred", "score")]
    text = F.col("text").cast("string")
    letter = F.coalesce(text.rlike("\\p{L}"), F.lit(False))
    d = documents.select(text.alias("_text"), F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in kept)).alias("_row"), letter.alias("_letter"))
    if net is None:
        return d.select("_row.*", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score")).drop("_")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema["_row"].dataType.fields[1:]]
    return d.mapInArrow(_predict(net, [*kept, "lang_pred", "score"]), ", ".join([*kinds, "lang_pred string, score double"]))
