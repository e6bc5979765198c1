"""Registered queries do the whole job: cases that a cut would leave out."""

import numpy as np

from pyspark.sql import functions as F

from kurvex.llm import decontaminate, interpolated_lm
from kurvex.llm import queries as corpus


def table(df, folder, name):
    df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_short_lines_are_deduplicated(spark, tmp_path):
    texts = ["Read more here\nfirst text\n\nx", "read  more HERE\nsecond text\n\nX", "one two three four five six seven\nread more there", "one two three four five six seven\nx"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_near, r.kept_chars) for r in corpus.op4_line_dedup(spark, table(docs, tmp_path, "documents")).collect()}
    assert got == {0: (0, 0, len(texts[0])), 1: (2, 0, len("second text\n")), 2: (0, 0, len(texts[2])), 3: (2, 0, 0)}


def test_mixture_weights_see_every_chunk(spark, monkeypatch):
    """The weights are learned from as many tokens as are trained on, at any number of chunks."""
    rng, seen = np.random.default_rng(3), []
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 40, 30)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    learn = interpolated_lm.learn_weights
    monkeypatch.setattr(interpolated_lm, "learn_weights", lambda cells: (seen.append(int(cells["n"].sum())), learn(cells))[1])
    scores = []
    for size in (8 << 20, 400):
        monkeypatch.setattr(interpolated_lm, "CHUNK_BYTES", size)
        rows = interpolated_lm.lm_scores(docs, F.col("doc_id") % 4 == 1).collect()
        assert seen[-1] == rows[0].train_tokens == 45 * 31
        scores.append([r.score for r in sorted(rows, key=lambda r: r.doc_id)])
    assert np.allclose(*scores)


def test_short_and_numeric_items_are_found(spark):
    short, digits, sums = "what rhymes with orange", "12 kg 5 m 7 s 9 km 31 h 4 t", "add 12 kg 5 m 7 s to 31 kg 9 m 8 s then 12 kg 5 m 4 s gives total"
    filler = " ".join(f"w{k}x" for k in range(30))
    texts = [f"{filler} {short} {filler}", f"{filler} {digits} {filler}", f"{filler} {sums} {filler}", f"{filler} {sums.replace('12', '77')} {filler}", f"{filler} {digits.replace('12', '77')} {filler}", f"{filler} {sums.replace('then 12', 'then 77')}", filler, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, short), (2, digits), (3, sums), (4, None), (5, " ")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert {(0, 1), (1, 2), (2, 3), (3, 3)} <= got <= {(0, 1), (1, 2), (2, 3), (3, 3), (4, 2), (5, 3)}
