"""Benchmark decontamination against its definition on strings: every window of every item and document, no hashes."""

import random
import re
import string
from collections import defaultdict

import pytest

from kurvex.llm import decontaminate as dc

WORDS = "the train leaves town and then reaches city after a long trip through hills while passengers read old books".split()
NAMES, UNITS = ["Anna", "Ben", "École", "Zoe"], ["km", "hours", "kg", "%"]


def tokens(text):
    """(template token, value, is a slot) of each word."""
    out, end, low = [], 0, {u for u in dc.UNITS}
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        core = m[0].strip(string.punctuation) or m[0]
        value = re.sub("[A-Z]", lambda c: c[0].lower(), core)
        before = out[-1] if out else None
        opens = not out or text[end - 1] in ".!?:" or "\n" in text[end : m.start()]
        number = bool(re.search("[0-9]", core))
        name = core[0] in string.ascii_uppercase + "É" and not opens and not number
        unit = value in low and before is not None and before[0] == "#n" and not number
        kind = "#n" if number else "#u" if unit else "#name" if name else value
        out.append((kind, value, kind[0] == "#" and len(kind) > 1))
        end = m.end()
    return out


def windows(toks, size, literals):
    """(place, template, values, slots, enough literals) of each window."""
    for i in range(len(toks) - size + 1):
        w = toks[i : i + size]
        yield i, tuple(t[0] for t in w), tuple(t[1] for t in w), tuple(t[1] if t[2] else None for t in w), sum(not t[2] for t in w) >= literals


def brute(docs, items, size, literals, share):
    found = set()
    for item, text in items.items():
        toks = tokens(text)
        tests, templates, exacts = [], set(), set()
        for i, t, v, s, usable in windows(toks, size, literals):
            tests.append((0 if usable else 1, i, size, usable, t if usable else v, s))
            (templates if usable else exacts).add(i)
        if toks and not templates:
            for i, t, v, s, usable in windows(toks, len(toks), literals):
                tests += [(2, i, len(toks), False, v, s)] + ([(2, i, len(toks), True, t, s)] if usable else [])
        total = max(1, len(templates) + len(exacts))
        for doc, body in docs.items():
            groups = defaultdict(list)
            seen = {n: list(windows(tokens(body), n, literals)) for n in {x[2] for x in tests}}
            for kind, place, n, by_template, key, slots in tests:
                for i, t, v, s, usable in seen[n]:
                    if (t == key and usable) if by_template else v == key:
                        groups[kind, i - place].append((place, slots, s))
            t, x, whole = set(), set(), False
            for (kind, _), hits in groups.items():
                maps = defaultdict(set)
                for _, a, b in hits:
                    for p, q in zip(a, b, strict=True):
                        if p is not None:
                            maps[p].add(q)
                if any(len(q) > 1 for q in maps.values()):
                    continue
                whole |= kind == 2
                (t if kind == 0 else x).update(h[0] for h in hits if kind < 2)
            matched = total if whole else len(t) + len(x)
            if (t or x or whole) and (matched >= share * total or (t and len(t) >= share * len(templates))):
                found.add((doc, item, matched, total))
    return found


def sentence(rng, n):
    pick = lambda: rng.choice(WORDS) if rng.random() < 0.66 else rng.choice(NAMES) if rng.random() < 0.4 else f"{rng.randint(1, 30)} {rng.choice(UNITS)}"
    return " ".join(pick() + (rng.choice(".,!") if rng.random() < 0.1 else "") for _ in range(n))


def altered(rng, text):
    """Numbers and names replaced, alike or (sometimes) not."""
    swap = {}
    new = lambda w, other: swap.setdefault(w, other) if rng.random() < 0.95 else other
    return " ".join(new(w, str(rng.randint(31, 99))) if w.isdigit() else new(w, rng.choice(NAMES)) if w in NAMES else w for w in text.split(" "))


@pytest.mark.parametrize("seed", [1, 2])
def test_every_window_by_definition(spark, seed):
    rng = random.Random(seed)
    items = {i: sentence(rng, rng.choice([1, 3, 7, 8, 9, 14, 20])) for i in range(14)}
    items |= {20: "", 21: "12 km", 22: items[3], 23: "Anna 3 km Ben 4 kg Zoe 5 hours Anna 6 km"}
    docs = {}
    for d in range(40):
        parts = [sentence(rng, rng.randint(0, 12))]
        for i in rng.sample(sorted(items), rng.randint(0, 2)):
            text = items[i] if rng.random() < 0.4 else altered(rng, items[i])
            if rng.random() < 0.3:
                text = " ".join(text.split(" ")[: rng.randint(1, 12)])
            parts += [text, sentence(rng, rng.randint(0, 6))]
        docs[d] = rng.choice([" ", "\n"]).join(parts)
    want = brute(docs, items, dc.WINDOW, dc.LITERALS, dc.SHARE)
    frame = lambda rows, key: spark.createDataFrame(list(rows.items()), f"{key} long, text string").repartition(3)
    got = {tuple(r) for r in dc.contaminated(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    assert got == want and len(want) > 10
