"""Joins, search and line templates against brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainwise.llm import line_templates, partenum_join, tokens, va_search


def shingle_sets(rows, width):
    out = {}
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        out[doc] = frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    return out


def brute_components(rows, width, num, den):
    sets = shingle_sets(rows, width)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    where = defaultdict(list)
    for d in ids:
        shared = Counter(e for s in sets[d] for e in where[s])
        for e, common in shared.items():
            if den * common >= num * (len(sets[d]) + len(sets[e]) - common):
                a, b = sorted((find(d), find(e)))
                root[b] = a
        for s in sets[d]:
            where[s].append(d)
    return {d: (len(sets[d]), find(d)) for d in ids}


def edited(rng, words, share):
    return [rng.choice(["x", "y", "z"]) + str(rng.randrange(10**6)) if rng.random() < share else w for w in words]


def families(seed):
    """Documents of all sizes with edits around the threshold, so that chains and stars occur."""
    rng = random.Random(seed)
    rows, n = [], 0
    for _ in range(12):
        size = rng.choice([2, 3, 5, 9, 14, 25, 40, 90, 200, 400])
        base = [f"w{rng.randrange(500)}" for _ in range(size)]
        for _ in range(rng.randrange(2, 14)):
            rows.append((n, " ".join(edited(rng, base, rng.choice([0, 0.003, 0.01, 0.02, 0.04, 0.1])))))
            n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("width", "num", "splits", "seed"), [(3, 90, 3, 1), (5, 80, 2, 2), (1, 80, 3, 3)])
def test_components_equal_brute_force(spark, width, num, splits, seed):
    rows = families(seed)
    got = partenum_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width, num, 100, splits).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, width, num, 100)


def test_every_link_shares_a_signature():
    """The guarantee of the signatures itself, for random pairs at the edge of the threshold."""
    rng = np.random.RandomState(0)
    for num in (80, 90):
        bands, linked = partenum_join.Bands(num, 100, 3), 0
        for _ in range(1500):
            n = int(rng.randint(5, 300))
            a = rng.randint(0, 2**63, size=n).astype(np.uint64)
            lost = int(rng.randint(0, max(2, n * (100 - num) // 100 + 1)))
            b = np.concatenate([a[lost:], rng.randint(0, 2**63, size=int(rng.randint(0, lost + 1))).astype(np.uint64)])
            a, b = np.unique(a), np.unique(b)
            common = len(np.intersect1d(a, b))
            if 100 * common >= num * (len(a) + len(b) - common) and common < max(len(a), len(b)):
                linked += 1
                one, two = (set(bands.signatures(x, tokens.mix(x)).tolist()) for x in (a, b))
                assert one & two
        assert linked > 200


def test_components_of_odd_rows(spark, odd, none):
    got = {(r.doc_id, r.n_shingles): r.component_id for r in partenum_join.jaccard_components(odd).collect()}
    sizes = {d: n for d, n in got}
    assert got[1, sizes[1]] == got[2, sizes[2]] == 1 and got[3, sizes[3]] == 1
    assert all(got[d, sizes[d]] == d for d in (4, 5, 6, 7, 8, 9, 10)) and sizes[4] == sizes[5] == sizes[6] == 0
    assert all(c is None for (d, _), c in got.items() if d is None)
    assert partenum_join.jaccard_components(odd).count() == odd.count()
    assert partenum_join.jaccard_components(none).count() == 0


def test_one_of_each_group_stays(spark, odd, none):
    kept = partenum_join.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 4, 5, 6, 7, 8, 9, 10]
    assert kept.where("doc_id is null").count() == 2
    assert partenum_join.one_of_each(none).count() == 0


def test_neighbours_find_every_shared_signature(spark):
    """Also where a signature of very many sets lies in several tasks, and of repeated rows."""
    rng = random.Random(3)
    rows = [(5, k) for k in range(3000)] + [(rng.randrange(-900, 900), rng.randrange(10**6)) for _ in range(900)]
    rows += rows[:40] + [(7000, 1)] * 50 + [(-9000, 2), (9000, 3)]
    want = defaultdict(set)
    for s, k in rows:
        want[s].add(k)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = partenum_join.neighbours(spark.createDataFrame(rows, "signature long, set_key long").repartition(7)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found, groups = defaultdict(set), defaultdict(set)
    for r in got:
        found[r.signature].add(r.set_key)
        if not r.edge:
            assert r.centre in want[r.signature] and r.centre <= r.set_key
            groups[r.signature].add(r.centre)
    borders = {(r.signature, r.set_key) for r in got if r.edge}
    for s, keys in want.items():
        if len(keys) > 1:
            assert found[s] == keys
            # every task's star is tied to the others by a border row
            assert len(groups[s]) <= 1 or len([1 for b in borders if b[0] == s]) >= len(groups[s])
        else:
            assert all((s, k) in borders for k in found[s])
    assert len(groups[5]) > 1


def test_sketches_bound_the_difference_of_large_sets(spark):
    """Linked sets are never ruled out, also where one sketch is twice the other; unlike large sets are."""
    rng = np.random.RandomState(5)
    rows, linked = [], []
    for i, (size, more, less) in enumerate([(1000, 60, 60), (1010, 80, 3), (4000, 200, 200), (4090, 300, 10), (9000, 800, 0), (5000, 5000, 4000), (1500, 1500, 1400)]):
        base = rng.randint(0, 2**63, size).astype(np.uint64)
        other = np.append(base[less:], rng.randint(0, 2**63, more).astype(np.uint64))
        linked.append(10 * (size - less) >= 8 * (size + more))
        for name, v in (("x", base), ("y", other)):
            rows.append((i, name, len(v), partenum_join.sketch(v).view(np.int64).tolist()))
    df = spark.createDataFrame(rows, "i int, name string, n long, sketch array<long>")
    x, y = df.where("name = 'x'").alias("x"), df.where("name = 'y'").alias("y")
    for one, two in (("x", "y"), ("y", "x")):
        got = x.join(y, F.col("x.i") == F.col("y.i")).select(F.col("x.i").alias("i"), partenum_join._may_link(one, two, 80, 100).alias("may")).collect()
        assert [r.may for r in sorted(got)] == linked


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (300, 299)]
    got = {r.node: r.root for r in partenum_join.components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}, 299: 299, 300: 299}


def brute_top(rows, k, scale=1024):
    def finite(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v)

    data = [(i, tuple(int(np.floor(scale * float(np.float32(x)))) for x in v)) for i, v in rows if i is not None and finite(v)]
    out = []
    for i, q in dict.fromkeys(d for d in data if d[0] % 100 == 0):
        found = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in data if j != i and len(v) == len(q))[:k]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(found, 1)]
    return sorted(out)


def test_search_equals_brute_force(spark, monkeypatch):
    rng = np.random.RandomState(3)
    rows = [(i, [float(x) for x in np.float32(rng.randn(6))]) for i in range(350)]
    rows += [(1000 + i, rows[5][1]) for i in range(60)]  # one vector very often: ties
    rows += [(700, None), (701, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (702, [float("nan")] * 6), (703, [float("inf")] * 6), (None, [1.0] * 6), (704, [1.0, 2.0]), (200, rows[200][1]), (3, rows[3][1])]
    monkeypatch.setattr(va_search, "SLICE_ROWS", 40)
    monkeypatch.setattr(va_search, "BLOCK_QUERIES", 2)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = sorted(tuple(r) for r in va_search.top_k(df, F.col("vec_id") % 100 == 0).collect())
    assert got == brute_top(rows, 10)


def test_search_with_few_or_no_candidates(spark):
    schema = "vec_id long, embedding array<float>, score string"
    few = spark.createDataFrame([(0, [1.0, 0.5], "a"), (1, [1.0, 1.0], None)], schema)
    assert [tuple(r) for r in va_search.top_k(few, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 1, 1024 * 1024 + 512 * 1024)]
    assert va_search.top_k(spark.createDataFrame([], schema), F.col("vec_id") % 100 == 0).count() == 0


def test_large_components_stay_exact():
    rng = np.random.RandomState(1)
    exact = rng.randint(-(2**30), 2**30, size=(500, 4))
    low = exact.min(axis=0)
    width = -(-(exact.max(axis=0) - low + 1) // va_search.CELLS)
    ids = np.arange(500)
    (rows, scores), = va_search.best_of_slice(exact[:1], ids[:1], ids, exact, ((exact - low) // width).astype(np.uint8), low, width, 5)
    want = sorted((-sum(int(a) * int(b) for a, b in zip(exact[0], exact[i], strict=True)), i) for i in range(1, 500))[:5]
    assert [(-s, i) for s, i in want] == list(zip(scores.tolist(), rows.tolist(), strict=True))


def test_line_templates(spark):
    prose = "the quick brown fox jumps over the lazy dog near the quiet river bank"
    rows = [
        (1, f"{prose}\nPage 12 of 40\nown line of one", 0),
        (2, f"{prose.replace('lazy', 'sleepy')}\nPage 13 of 40\n\nown line of two", 0),
        (3, "Page 9 of 12", 0),
        (4, "the quick brown cat runs under a busy dog near the noisy river bank", 0),
    ]
    df = line_templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string, n_chars long"))
    got = {r.doc_id: (r.text, r.n_dropped_lines) for r in df.collect()}
    assert got == {1: (rows[0][1], 0), 2: ("\nown line of two", 2), 3: ("", 1), 4: (rows[3][1], 0)}
    assert {r.doc_id: r.n_chars for r in df.collect()} == {1: 0, 2: len("\nown line of two"), 3: 0, 4: 0}


def test_line_templates_of_odd_rows(odd, none):
    got = line_templates.drop_recurring(odd)
    assert got.columns == [*odd.columns, "n_dropped_lines"] and got.count() == odd.count()
    texts = {(r.doc_id, r.source): r.text for r in got.collect()}
    assert texts[1, "s"] and texts[2, "s"] == "" and texts[3, "s"] == "" and texts[6, "s"] is None and texts[4, "s"] == ""
    assert got.where("doc_id is null and text is not null").count() == 1
    assert line_templates.drop_recurring(none).count() == 0


def test_wide_templates_have_two_runs_open_and_short_lines_a_rule(spark):
    prose = "the quick brown fox jumps over the lazy dog near the quiet river bank today"
    rows = [
        (1, f"{prose}\nPosted by Alice on Monday\nHow to bake fine bread"),
        (2, f"{prose.replace('fox', 'cat').replace('river', 'lake')}\nPosted by Alma on Friday\nHow to fell a tree"),
        (3, "Posted by Bob on Sunday\nHow to mend old shoes\nPosted by whom it may"),
        (4, f"{prose.replace('fox', 'cat').replace('lazy', 'big').replace('today', 'now').replace('jumps', 'sits')}"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_templates.drop_recurring(df, wide=True).collect()}
    assert got == {1: rows[0][1], 2: "How to fell a tree", 3: "How to mend old shoes\nPosted by whom it may", 4: rows[3][1]}


def test_wide_templates_drop_what_the_narrow_ones_drop(spark, odd, none, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for df in (docs, odd):
        narrow, wide = ({(r["__doc"], r["__same"]): set(r["__lines"]) for r in line_templates.repeated_lines(df, wide=w).collect()} for w in (False, True))
        assert narrow and all(lines <= wide[k] for k, lines in narrow.items())
    assert line_templates.drop_recurring(odd, wide=True).count() == odd.count() and line_templates.drop_recurring(none, wide=True).count() == 0


def wide_brute(rows):
    """Lines that go by the wide rule, from templates written out as tuples of tokens and gaps."""
    from itertools import combinations

    keys, first, leaf_lines, uses = defaultdict(list), {}, Counter(), Counter()
    for doc, text in rows:
        for i, raw in enumerate(text.split("\n")):
            toks = ["<*>" if any(c in "0123456789" for c in w) else w for w in raw.split()]
            n = len(toks)
            if not n:
                continue
            leaf = (n, *toks[:2])
            leaf_lines[leaf] += 1
            own = [("whole", *toks)]
            if n >= 8:
                cut = [2 + (n - 2) * j // 8 for j in range(9)]
                own += [(leaf, g, *(tuple(toks[cut[j] : cut[j + 1]]) for j in range(8) if j not in g)) for g in combinations(range(8), 2)]
            elif n >= 4:
                own += [("short", leaf, g, *(toks[j] for j in range(2, n) if j not in g)) for g in combinations(range(2, n), min(2, int(n * 0.4 + 1e-9)))]
            for k in own:
                keys[doc, i].append(k)
                first[k] = min(first.get(k, doc), doc)
                uses[k] += 1
    rules = lambda k: k[0] != "short" or (uses[k] >= 3 and uses[k] >= 0.5 * leaf_lines[k[1]])
    return {(doc, i) for (doc, i), own in keys.items() if any(first[k] < doc and rules(k) for k in own)}


def test_wide_templates_equal_brute_force(spark, sf):
    rng = random.Random(8)
    words = [f"w{chr(97 + i)}" for i in range(6)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randrange(9)):
            n = rng.choice([1, 3, 4, 5, 6, 7, 8, 9, 12, 17])
            base = [words[(i * 5 + n) % 6] for i in range(n)]
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                base[rng.randrange(n)] = rng.choice([*words, "7", f"x{d}"])
            lines.append(rng.choice([" ", "  ", "\t"]).join(base))
        rows.append((d, "\n".join(lines)))
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for own in (rows, docs):
        df = spark.createDataFrame(own, "doc_id long, text string").repartition(5)
        got = {(r["__doc"], i) for r in line_templates.repeated_lines(df, wide=True).collect() for i in r["__lines"]}
        assert got == wide_brute(own) and got


def test_clashing_names_stay(spark):
    df = spark.createDataFrame([(1, "a line", 5, 6), (2, "a line", 7, 8)], "doc_id long, text string, __doc long, __same long").selectExpr("*", "9 as __lines", "3 as __gone", "4 as __again", "1 as whole", "2 as leaf")
    got = line_templates.drop_recurring(df, wide=True)
    assert got.columns == [*df.columns, "n_dropped_lines"] and {r.doc_id: (r.text, r["__same"], r["__lines"], r.leaf) for r in got.collect()} == {1: ("a line", 6, 9, 2), 2: ("", 8, 9, 2)}
    kept = partenum_join.one_of_each(df)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(1, "a line", 5, 6, 9, 3, 4, 1, 2)]
