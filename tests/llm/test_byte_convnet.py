"""The byte network: responses and gradients by definition, windows that miss nothing, held-out accuracy, odd rows."""

import numpy as np
import pyarrow as pa
import pytest

from kurvex.llm import byte_convnet as bc
from kurvex.llm import queries as corpus

SF = "/root/testdata/sf0.01"


def by_definition(net, window):
    hidden = []
    for k, w, b in zip(net.widths, net.filters, net.biases, strict=True):
        for f in range(w.shape[1]):
            seen = [float(np.concatenate([net.embed[c] for c in window[i : i + k]]) @ w[:, f]) for i in range(len(window) - k + 1)]
            hidden.append(max(0.0, max(seen) + float(b[f])))
    z = np.array(hidden) @ net.out + net.out_bias
    return np.exp(z - z.max()) / np.exp(z - z.max()).sum()


def small(seed=3, kind=np.float64):
    net = bc.new_net(["a", "b", "c"], seed, (2, 3, 4, 5), 3, 2, kind)
    for b in net.biases:
        b += np.random.default_rng(seed).normal(0, 0.1, len(b))
    return net


def test_probabilities_by_definition():
    net, windows = small(), np.random.default_rng(0).integers(0, 256, (6, 40)).astype(np.uint8)
    assert np.allclose(net.probabilities(windows), [by_definition(net, w) for w in windows], atol=1e-9)


def test_gradients_by_differences():
    net, rng = small(), np.random.default_rng(1)
    windows, language = rng.integers(0, 256, (5, 30)).astype(np.uint8), rng.integers(0, 3, 5)
    loss, grads = net.gradients(windows, language)
    assert np.isclose(loss, -np.log(net.probabilities(windows)[np.arange(5), language]).mean())
    for p, g in zip(net.parameters(), grads, strict=True):
        for at in {tuple(rng.integers(0, n) for n in p.shape) for _ in range(12)} | {np.unravel_index(np.abs(g).argmax(), g.shape)}:
            old, p[at] = p[at], p[at] + 1e-6
            up = net.gradients(windows, language)[0]
            p[at] = old - 1e-6
            down = net.gradients(windows, language)[0]
            p[at] = old
            assert np.isclose((up - down) / 2e-6, g[at], atol=1e-5)


@pytest.mark.parametrize("size", [0, 1, 4, 255, 256, 257, 509, 510, 5000])
def test_windows_hold_every_ngram(size):
    raw = np.random.default_rng(size).integers(1, 256, size + 20).astype(np.uint8)
    off = np.array([10, 10 + size, 20 + size])
    text, start = bc.window_starts(off, bc.WINDOW - max(bc.WIDTHS) + 1)
    own = bc.cut(raw, start[text == 0], np.full((text == 0).sum(), off[1]))
    seen = {w[i : i + 4].tobytes() for w in own for i in range(bc.WINDOW - 3)}
    assert {raw[i : i + 4].tobytes() for i in range(10, 10 + size - 3)} <= seen and (np.bincount(text, minlength=2) > 0).all()
    assert sum((w > 0).sum() for w in own) >= size and not (own[-1][max(0, size - (start[text == 0][-1] - 10)) :]).any()


def test_texts_are_the_means_of_their_windows():
    net = bc.new_net(["a", "b"], 2)
    texts = ["abc def " * 200, "", "x", "1 2 3 " * 100 + "letters"]
    raw, off = bc.text_buffers(pa.array(texts))
    got = bc.text_probabilities(net, raw, off)
    assert np.allclose(got.sum(1), 1) and np.allclose(got, [bc.text_probabilities(net, *bc.text_buffers(pa.array([t])))[0] for t in texts], atol=1e-6)


def test_held_out_accuracy(spark):
    rows = corpus.op11_language_id(spark, SF).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and len(out) > 250 and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in out]) > 0.97


def test_odd_rows(spark):
    texts = [(1, None), (2, ""), (3, " \n 12 #"), (4, "the and of the"), (None, "der und die"), (4, "the and of the"), (5, "é" * 300_000), (6, "数字"), (7, "\x00" * 600 + "a")]
    docs = spark.createDataFrame([(i, t, "c", "c", "c") for i, t in texts], "doc_id long, text string, score string, _text string, _row string").repartition(2)
    labelled = spark.createDataFrame([("the and of with " * 9, "en"), ("der und die mit " * 9, "de"), (None, "xx"), ("lost", None), ("", "yy")] * 8, "text string, lang string")
    net = bc.fit_language_model(labelled)
    assert net.languages == ["de", "en"]
    out = bc.predict_language(docs, net, ["doc_id", "score", "_row"])
    assert out.columns == ["doc_id", "_row", "lang_pred", "score"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in out.collect()}
    assert out.count() == len(texts) and {k for k, (p, s) in got.items() if p == "und" and s == 0} == {1, 2, 3}
    assert got[4][0] == "en" and got[None][0] == "de" and got[6][0] in net.languages
    none = bc.predict_language(docs, bc.fit_language_model(labelled.where("lang is null")), ["doc_id"])
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)} and none.columns == ["doc_id", "lang_pred", "score"]
