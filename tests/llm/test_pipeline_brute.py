"""Each stage of the pipeline, on what its predecessor really kept of a given table, against its definition in plain Python."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from test_decontaminate_brute import tokens, windows

from kurvex.llm import decontaminate as dc
from kurvex.llm.toxicity import fit_toxicity, labelled_sample, score_toxicity

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def one_edit(a, b):
    """Words differ by one substitution, insertion or deletion at most."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    s, t = sorted((a, b), key=len)
    return len(t) - len(s) == 1 and any(t[:i] + t[i + 1 :] == s for i in range(len(t)))


def kept_lines(texts):
    """Texts without lines that are equal or near to an earlier line that has five words or more (equal: any)."""
    seen, by_piece, out = set(), defaultdict(list), {}
    for doc, text in sorted(texts.items()):
        kept = []
        for line in (text or "").split("\n"):
            w = tuple(WORD.findall(lower(line)))
            if w and w in seen:
                continue
            gone = False
            if len(w) >= 5:
                half = len(w) // 2
                pieces = [("a", w[:k]) for k in range(max(1, half - 1), half + 2)] + [("z", w[len(w) - k :]) for k in range(max(1, half - 1), half + 2)]
                gone = any(one_edit(w, v) for p in pieces for v in by_piece[p])
                for p in pieces:
                    by_piece[p].append(w)
            seen.add(w)
            if not gone:
                kept.append(line)
        out[doc] = "\n".join(kept)
    return out


def least_of_components(texts):
    sets = {}
    for d, t in texts.items():
        w = WORD.findall(lower(t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d for d in sets if find(d) == d}


def leaks(docs, items, size, literals, share):
    """Documents in which an item is found, as in the other file; windows are looked up by their words."""
    tests, totals, out = defaultdict(list), {}, set()
    for item, text in items.items():
        toks, templates, exacts = tokens(text), set(), set()
        for i, t, v, s, usable in windows(toks, size, literals):
            tests[usable, t if usable else v].append((item, 0 if usable else 1, i, s))
            (templates if usable else exacts).add(i)
        if toks and not templates:
            for i, t, v, s, usable in windows(toks, len(toks), literals):
                tests[False, v].append((item, 2, i, s))
                if usable:
                    tests[True, t].append((item, 2, i, s))
        totals[item] = max(1, len(templates) + len(exacts)), len(templates)
    sizes = {len(k[1]) for k in tests}
    for doc, body in docs.items():
        toks, groups = tokens(body), defaultdict(list)
        for n in sizes:
            for i, t, v, s, usable in windows(toks, n, literals):
                for key in [(True, t)] * usable + [(False, v)]:
                    for item, kind, place, slots in tests.get(key, ()):
                        groups[item, kind, i - place].append((place, slots, s))
        good = defaultdict(lambda: [set(), set(), set()])
        for (item, kind, _), hits in groups.items():
            maps = defaultdict(set)
            for _, a, b in hits:
                for p, q in zip(a, b, strict=True):
                    if p is not None:
                        maps[p].add(q)
            if all(len(q) == 1 for q in maps.values()):
                good[item][kind].update(h[0] for h in hits)
        for item, (t, x, whole) in good.items():
            total, templates = totals[item]
            if whole or len(t) + len(x) >= share * total or (t and len(t) >= share * templates):
                out.add(doc)
    return out


def test_stages_by_definition(spark):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    from kurvex.llm.queries import vocabulary

    stages = dict(p.STAGES)
    docs = spark.read.parquet(f"{DIR}/documents.parquet")

    def after(name, docs):
        out = spark.createDataFrame(stages[name](spark, docs, DIR).collect(), docs.schema)
        return out, {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.text for r in out.collect()}

    model = fit_toxicity(labelled_sample(docs, spark.read.parquet(f"{DIR}/labels.parquet")))
    fine = {r.doc_id for r in score_toxicity(docs, model, ["doc_id"]).where("score < 0.5").collect()}
    docs, given, kept = after("toxicity", docs)
    assert kept == {d: given[d] for d in fine} and len(kept) > 0.8 * len(given)

    docs, given, kept = after("line_dedup", docs)
    lines = kept_lines(given)
    want = {d: t for d, t in lines.items() if WORD.search(t) or t == (given[d] or "")}
    strip = lambda t: [x for x in (t or "").split("\n") if WORD.search(x)]
    assert kept.keys() == want.keys() and all(strip(kept[d]) == strip(want[d]) for d in want) and any(kept[d] != given[d] for d in kept)

    docs, given, kept = after("ngram_jaccard_join", docs)
    assert kept == {d: given[d] for d in least_of_components(given)}

    docs, given, kept = after("decontamination", docs)
    items = {r.item_id: r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()}
    found = leaks({d: t or "" for d, t in given.items()}, items, dc.WINDOW, dc.LITERALS, dc.SHARE)
    assert kept == {d: t for d, t in given.items() if d not in found} and found

    whole = Tokenizer.from_file(vocabulary())
    whole.no_truncation()
    whole.no_padding()
    for r in stages["bpe"](spark, docs, DIR).collect():
        ids = whole.encode(kept[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(whole.decode(ids, skip_special_tokens=False).encode()).hexdigest()
