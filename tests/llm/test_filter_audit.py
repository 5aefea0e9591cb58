"""The filter audit against applying the filters one after the other, and its potential against orders."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

import pytest

from grainwise.llm import filter_audit

LABELS = "doc_id long, quality int, toxic int"


def fails(text, words):
    out = "A" if len(words) < 200 else ""
    out += "B" if 100 * len(set(words)) < 50 * len(words) else ""
    out += "C" if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text) else ""
    return out + ("D" if re.search(r"[#$%&*|]", text) else "")


def brute(rows, labels):
    """Counts of every part, order and step, by removing document after document."""
    docs = []
    for key, text, part in rows:
        t = text or ""
        f = fails(t, [w for w in re.split("[ \t-\r]+", t) if w])
        if key is not None and any(k is not None and k < key and (x or "") == t for k, x, _ in rows):
            f += "E"
        good, toxic = (int(any(r[0] == key and r[i] == 1 for r in labels)) if key is not None else 0 for i in (1, 2))
        docs.append((part or "", f, good, toxic))
    out, by_filter = {}, Counter()
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                failing = [d for d in own if x in d[1]]
                out[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(d[1] == x for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                by_filter[part, x] += len(gone)
    return {k: (*v, by_filter[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, rows, labels, extra=()):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).selectExpr("*", *extra)
    got = filter_audit.audit_documents(docs, spark.createDataFrame(labels, LABELS)).collect()
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got}


def test_audit_equals_filtering_one_by_one(spark):
    rng = random.Random(5)
    long, loud = " ".join(f"w{i}" for i in range(210)), " ".join(f"W{i}X" for i in range(220))
    pool = ["", None, " \t\n", "few words", "A #1", long, long + " |", loud, " ".join(["ab"] * 300), "ÄÖÜ É", long.replace(" ", "\x0b"), "AB" + "x" * 98, "AB" + "x" * 97]
    rows = [(rng.choice([None, *range(40)]), rng.choice(pool), rng.choice(["s", "t", None, ""])) for _ in range(120)]
    rows += rows[:5]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 40, 2)] + [(4, 1, 1), (None, 1, 1), (99, 1, 1)]
    want = brute(rows, labels)
    assert audited(spark, rows, labels) == want
    clashing = ["1 as key", "'x' as part", "2 as mask", "3 as n", "4 as good", "5 as toxic", "6 as label_key", "7 as join_key", "8 as first", "9 as digest"]
    assert audited(spark, rows, labels, clashing) == want


def test_one_text_everywhere_and_empty_tables(spark, none):
    rows = [(i, "same", "hot") for i in range(500)] + [(3, "same", "cold")]
    got = audited(spark, rows, [])
    assert got == brute(rows, [])
    assert got["hot", "EABCD", 1][:2] == (1, 499)
    assert filter_audit.audit_documents(none, spark.createDataFrame([], LABELS)).count() == 0


@pytest.mark.parametrize("k", [1, 2, 4])
def test_shapley_of_other_numbers_of_filters(spark, k):
    rng = random.Random(k)
    counts = [("p", m, rng.randrange(50), rng.randrange(9)) for m in range(1 << k)]
    got = filter_audit.audit(spark.createDataFrame(counts, "part string, mask int, n long, extra long"), "VWXYZ"[:k], {"extra": "extra_lost"}).collect()
    total = Counter()
    for order in permutations(range(k)):
        gone = 0
        for i in order:
            total[i] += sum(n for _, m, n, _ in counts if m >> i & 1 and not m & gone)
            gone |= 1 << i
    assert {r.filter_order[r.step - 1]: r.shapley for r in got} == {"VWXYZ"[i]: n for i, n in total.items()}
    with pytest.raises(ValueError):
        filter_audit.audit(spark.createDataFrame(counts, "part string, mask int, n long, extra long"), "AA", {})
