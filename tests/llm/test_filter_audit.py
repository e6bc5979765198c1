"""The filter audit against filters that are applied one after another, document by document."""

import re
from itertools import permutations

import pytest

from kurvex.llm.filter_audit import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ROWS = (
    [(1, "one two", "en"), (2, None, "en"), (3, "", None), (4, "", ""), (None, "one two", "en"), (None, None, None), (5, "one two", "de"), (5, "one two", "de"), (1, "one two", "fr")]
    + [(10 + k, " ".join(f"w{j % (150 + 40 * k)}" for j in range(260)) + (" #" if k % 2 else ""), "en") for k in range(6)]
    + [(30 + k, "\n".join(f"Aa{j}É\U0001f600" if j % (k + 1) else "lower" for j in range(220)), ["en", None, "de"][k % 3]) for k in range(6)]
    + [(40 + k, "word " * 250, "de") for k in range(4)]
    + [(50, "x" * 70_000 + " " + " ".join(f"q{j}" for j in range(90_000)), "de"), (51, "   A\x00B\x0b", "es")]
)
LABELS = [(k, k % 2, k % 3 == 0) for k in (1, 2, 5, 10, 11, 12, 31, 33, 40, 41, 43, 50)] + [(5, 1, 0), (12, None, None), (None, 1, 1)]


def brute(rows, labels):
    rows = [(i, t or "", p or "") for i, t, p in rows]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    fails = []
    for i, t, _ in rows:
        w = WORD.findall(t)
        e = i is not None and any(j is not None and j < i and u == t for j, u, _ in rows)
        fails.append({"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": e})
    out = {}
    for part in {p for *_, p in rows}:
        mine = [(i, f) for (i, _, p), f in zip(rows, fails, strict=True) if p == part]
        removed = {f: 0 for f in "ABCDE"}
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                here, gone = [x for x in left if x[1][f]], [x for x in mine if x not in left]
                left = [x for x in left if not x[1][f]]
                removed[f] += len(here)
                redundant = sum(x[1][f] for x in mine) - len(here)
                unique = sum(x[1][f] and sum(x[1].values()) == 1 for x in mine)
                assert redundant == sum(x[1][f] for x in gone)
                out[part, "".join(order), k + 1] = [len(left), len(here), redundant, unique, sum(x[0] in good for x in here), sum(x[0] in toxic for x in here)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(removed[order[k - 1]])
    return out


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "c", "c") for r in rows], "doc_id long, text string, lang string, part string, word string").repartition(3)
    return docs, spark.createDataFrame([(i, q, None if x is None else int(x), "c") for i, q, x in labels], "doc_id long, quality int, toxic int, label_id string")


@pytest.mark.parametrize("labels", [LABELS, []])
def test_audit_equals_filters_applied_in_turn(spark, labels):
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filter_audit(*frames(spark, ROWS, labels)).collect()}
    assert got == brute(ROWS, labels)


def test_empty_table(spark):
    assert filter_audit(*frames(spark, [], LABELS)).collect() == []
