"""Fitted models: exact parts against brute force, learned parts on held-out rows."""

from __future__ import annotations

import math
import pickle
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grainwise.llm import language_id, latent_decontamination, maxent_lm, tokens, toxicity
from grainwise.llm.fitting import sparse


def crc(doc, parts):
    return zlib.crc32(str(doc).encode()) % parts


def brute_base(rows, held):
    texts = {d: [*(t or "").encode().lower().split(), None] for d, t in rows}
    count = Counter(w for d, t in texts.items() if d not in held for w in t)
    n, v = sum(count.values()), len(count)
    floor = math.log10(n + 0.5 * (v + 1))
    return {d: (len(t), sum(count[w] > 0 for w in t), n, sum(math.log10(count[w] + 0.5) - floor for w in t)) for d, t in texts.items()}


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, maxent_lm.score(docs).collect()


def test_language_model_counts_equal_brute_force(spark, scored):
    docs, got = scored
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    held = {d for d, _ in rows if crc(d, 5) == 1}
    want = brute_base(rows, held)
    assert len(got) == len(rows) and {r.doc_id for r in got if r.held_out} == held
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert r.base_score == pytest.approx(want[r.doc_id][3], rel=1e-9)


def test_language_model_beats_word_counts_on_held_out_texts(scored):
    held = [r for r in scored[1] if r.held_out]
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert gain > 0.2 and np.mean([r.score > r.base_score for r in held]) > 0.95


def test_rare_words_are_joined_exactly(spark, monkeypatch):
    """With few words travelling along, the rest goes through the join."""
    monkeypatch.setattr(maxent_lm, "COMMON", 20)
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{int(rng.expovariate(0.05))}" for _ in range(rng.randrange(0, 60)))) for i in range(60)] + [(90, None), (91, "never seen words")]
    held = {d for d, _ in rows if crc(d, 5) == 1} | {91}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in maxent_lm.score(df, (F.crc32(F.col("doc_id").cast("string")) % 5 == 1) | (F.col("doc_id") == 91)).collect()}
    for d, want in brute_base(rows, held).items():
        assert (got[d].n_tokens, got[d].n_known, got[d].train_tokens) == want[:3]
        assert got[d].base_score == pytest.approx(want[3], rel=1e-9)
        assert got[d].score < 0


def test_model_is_a_probability_distribution(spark):
    """Over all one-word texts, seen ones and one unseen for each class, the probabilities add up to that of any word."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["aa", "bb", "cc", "dd"]) for _ in range(8))) for i in range(40)]
    probes = [(1000 + i, w) for i, w in enumerate(["aa", "bb", "cc", "dd", ""])]
    df = spark.createDataFrame(rows + probes, "doc_id long, text string")
    got = {r.doc_id: r.score for r in maxent_lm.score(df, F.col("doc_id") >= 1000).collect()}
    assert all(s < 0 for s in got.values())
    assert sum(10 ** got[d] for d, _ in probes) < 1


def test_hash_index():
    keys = np.unique(np.random.RandomState(1).randint(0, 2**63, size=5000).astype(np.uint64))
    keys = np.append(keys, np.uint64(0))
    index = maxent_lm.HashIndex(keys)
    assert (index.find(keys) == np.arange(len(keys))).all()
    assert (index.find(keys[:-1] + np.uint64(1)) >= 0).sum() == np.isin(keys[:-1] + np.uint64(1), keys).sum()
    assert maxent_lm.HashIndex(keys[:0]).find(keys[:3]).tolist() == [-1] * 3


def test_language_model_of_odd_rows(odd, none):
    got = maxent_lm.score(odd).collect()
    assert len(got) == odd.count() and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[4].n_tokens == by[5].n_tokens == by[6].n_tokens == 1 and by[7].n_tokens == 60_001
    assert maxent_lm.score(none).count() == 0


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    layout, weights = language_id.fit(docs.where(~held))
    got = language_id.predict(docs, layout, weights, kept={"lang": F.col("lang"), "held": held}).where("held").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_trigrams_stay_inside_their_row():
    texts = ["Abc!", "", "é x", "12", "abc"]
    buckets, at = language_id.trigrams(*tokens.text_buffer(pa.array(texts)))
    assert np.diff(at).tolist() == [3, 0, 3, 0, 3]
    assert buckets[at[0] : at[1]].tolist() == buckets[at[4] : at[5]].tolist()
    for i, t in enumerate(texts):
        alone, _ = language_id.trigrams(*tokens.text_buffer(pa.array([t])))
        assert alone.tolist() == buckets[at[i] : at[i + 1]].tolist()


def test_language_of_odd_rows(spark, odd, none):
    layout, weights = language_id.fit(odd)
    got = {r.doc_id: r for r in language_id.predict(odd, layout, weights).collect()}
    assert layout.languages == ("de", "en") and got[7].lang_pred == "de" and got[1].lang_pred == "en"
    assert all(got[d].lang_pred == "und" and got[d].score == 0 for d in (4, 5, 6, 9, None) if got[d].lang_pred != "en")
    assert language_id.predict(none, layout, weights).count() == 0
    nothing = language_id.predict(odd, *language_id.fit(none)).collect()
    assert len(nothing) == odd.count() and {r.lang_pred for r in nothing} == {"und"}


def test_three_families_and_a_lonely_language(spark):
    sound = {"de": "sch ung keit", "en": "the ing th", "fr": "eau oui ai", "es": "os cion rr", "xx": "zq qz zz"}
    rng = random.Random(1)
    rows = [(i * 5 + j, " ".join(rng.choice(s.split()) + rng.choice(s.split()) for _ in range(30)), lang) for i in range(30) for j, (lang, s) in enumerate(sound.items())]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    layout, weights = language_id.fit(df.where("doc_id < 100"))
    assert layout.families == ("germanic", "romance", "xx") and len(layout.pairs) == 2
    got = language_id.predict(df, layout, weights, kept={"lang": F.col("lang")}).where("doc_id >= 100").collect()
    assert all(r.lang == r.lang_pred and r.score > 0.5 for r in got)


def toxic_rows(n, seed):
    rng = random.Random(seed)
    common, bad = [f"word{i}" for i in range(400)], [f"slur{i}" for i in range(12)]
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.3
        words = [rng.choice(common) for _ in range(rng.randrange(20, 200))]
        if toxic:
            for _ in range(rng.choice([1, 2, 10, 20])):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "!", ","]))
        docs.append((i, " ".join(words), sum(w.startswith("slur") for w in words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_severity_on_held_out_documents(spark):
    docs, labels = toxic_rows(900, 7)
    df, known = spark.createDataFrame(docs, "doc_id long, text string, slurs int"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(df, known.where("doc_id < 600"))
    assert (np.diff(model.thresholds) > 0).all() and len(model.words) <= toxicity.WORDS
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    held = [(got[i], n) for i, _, n in docs if i >= 600]
    assert np.mean([r.rejected == (n > 0) for r, n in held]) > 0.97
    assert not any(r.rejected for r, n in held if n == 0)
    assert all(0 <= r.severity <= 2 for r, _ in held)
    mean = lambda few, many: np.mean([r.severity for r, n in held if few <= n <= many])
    assert mean(0, 0) < mean(1, 2) < mean(10, 30)
    assert {r.doc_id for r in toxicity.accepted(df, model).collect()} == {d for d, r in got.items() if not r.rejected}


def test_ordinal_gradient_is_that_of_the_loss(spark):
    """The gradient that the tasks return, by finite differences."""
    docs, labels = toxic_rows(60, 1)
    seen = []
    original = toxicity.lbfgs
    try:
        toxicity.lbfgs = lambda rows, part, start, steps: seen.append((part, rows.toArrow().to_batches()[0], start)) or start
        toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string, slurs int"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    finally:
        toxicity.lbfgs = original
    part, batch, start = seen[0]
    w = start + np.random.RandomState(0).randn(len(start)) * 0.3
    _, gradient = part(batch, w)
    n = len(w) - 2
    for i in [0, 1, n, n + 1]:
        step = np.zeros(len(w))
        step[i] = 1e-5
        slope = (part(batch, w + step)[0] - part(batch, w - step)[0]) / 2e-5
        assert slope == pytest.approx(gradient[i], abs=1e-6)
    assert sparse(batch, "ids", "values")[0].max() < batch.num_rows


def test_severity_is_fitted_with_batches_of_clean_rows_only_and_clashing_columns(spark):
    docs, labels = toxic_rows(60, 1)
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    plain = spark.createDataFrame(docs, "doc_id long, text string, slurs int")
    clashing = plain.selectExpr("doc_id", "text", "text as toxic", "1 as __key", "2 as __doc", "3 as words", "4 as grade")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        one, two = (toxicity.fit(x, labels) for x in (plain, clashing))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(one.words) and one.words.tolist() == two.words.tolist()
    assert one.weights == pytest.approx(two.weights, abs=1e-3)


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, None), (7, 0)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and not any(r.rejected for r in got if r.doc_id in (4, 5, 6))
    assert toxicity.accepted(odd, model).columns == odd.columns
    assert toxicity.score(none, model).count() == 0
    nothing = toxicity.fit(odd, labels.where("doc_id = 7"))
    assert {(r.grade, r.rejected, r.severity) for r in toxicity.score(odd, nothing).collect()} == {(0, False, 0.0)}


def test_leaks_and_paraphrases(spark):
    rng = random.Random(11)
    vocabulary = [f"t{i}" for i in range(3000)]
    text = lambda n: [rng.choice(vocabulary) if rng.random() < 0.7 else rng.choice(["the", "of", "and", "to"]) for _ in range(n)]
    items = [(i, " ".join(text(rng.randrange(15, 60)))) for i in range(40)] + [(100, None), (101, ""), (None, "some text"), (3, "repeated")]
    docs, want = [], {}
    for i in range(240):
        words, kind = text(rng.randrange(5, 400)), i % 4
        item = items[i % 40][1].split()
        if kind == 1:  # literal, in other case and with marks
            words[len(words) // 2 : len(words) // 2] = [w.upper() + "," for w in item]
        if kind == 2:  # a fifth of the words replaced, some words put in
            changed = [rng.choice(vocabulary) if rng.random() < 0.2 else w for w in item]
            for _ in range(len(item) // 10):
                changed.insert(rng.randrange(len(changed)), "indeed")
            words[len(words) // 2 : len(words) // 2] = changed
        docs.append((i, " ".join(words)))
        want[i] = [i % 40] if kind in (1, 2) else []
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in latent_decontamination.find_leaks(df, bench).collect()}
    kinds = [np.mean([got[i].item_ids == want[i] for i in want if i % 4 == k]) for k in range(4)]
    assert kinds[0] == kinds[3] == 1 and kinds[1] == 1 and kinds[2] > 0.9
    assert {r.doc_id for r in latent_decontamination.without_leaks(df, bench).collect()} == {i for i, r in got.items() if not r.leaked}


def test_candidate_recall_against_all_windows(spark):
    """Latent candidates against the cosines of the full vectors of all windows."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    (ids, texts), = latent_decontamination.item_blocks(bench, "item_id", "text")
    items = latent_decontamination.prepared(docs, ids, texts)
    full = np.zeros((len(ids), len(items.words)))
    for i, t in enumerate(texts):
        place, n = np.unique(np.searchsorted(items.words, t), return_counts=True)
        full[i, place] = n * items.idf[place]
    full /= np.linalg.norm(full, axis=1, keepdims=True)
    wanted = found = 0
    for row in docs.collect():
        h, _, at = tokens.words(*tokens.text_buffer(pa.array([row.text])), tokens.MARKS)
        got = {(a, i) for _, a, i, _ in latent_decontamination.candidates(h, at, items)}
        last = max(0, len(h) - latent_decontamination.WINDOW)
        for a in range(0, last + latent_decontamination.STRIDE if len(h) else 0, latent_decontamination.STRIDE):
            place, n = np.unique(h[a : a + latent_decontamination.WINDOW], return_counts=True)
            known = toxicity.present(place, items.words)
            weight = n * np.where(known >= 0, items.idf[np.maximum(known, 0)], items.other_idf[(place & np.uint64(latent_decontamination.BUCKETS - 1)).astype(np.int64)])
            vector = np.zeros(len(items.words))
            vector[known[known >= 0]] = weight[known >= 0]
            for i in np.flatnonzero(full @ vector / np.sqrt((weight**2).sum() + 1e-12) >= latent_decontamination.LEAST_COSINE):
                wanted += 1
                found += (a, int(i)) in got
    assert wanted > 5 and found / wanted >= 0.9


def test_blocks_of_items_give_the_same(spark, odd, none, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = sorted((r.doc_id, r.item_ids) for r in latent_decontamination.find_leaks(docs, bench).collect())
    assert sum(bool(x) for _, x in whole) >= 3
    monkeypatch.setattr(latent_decontamination, "BLOCK_ITEMS", 15)
    assert whole == sorted((r.doc_id, r.item_ids) for r in latent_decontamination.find_leaks(docs, bench).collect())
    assert latent_decontamination.find_leaks(odd, bench).count() == odd.count() == latent_decontamination.without_leaks(odd, bench).count()
    assert latent_decontamination.find_leaks(none, bench).count() == 0
    assert not any(r.leaked for r in latent_decontamination.find_leaks(odd, bench.where("item_id < 0")).collect())
    own = spark.createDataFrame([(1, odd.where("doc_id = 1").first().text)], "item_id long, text string")
    assert {r.doc_id for r in latent_decontamination.find_leaks(odd, own).where("leaked").collect()} == {1, 2, 3, None}


def test_common_subsequence():
    def slow(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    rng = np.random.RandomState(0)
    for _ in range(60):
        a, b = rng.randint(0, 6, size=rng.randint(1, 70)), rng.randint(0, 6, size=rng.randint(0, 90))
        assert latent_decontamination.common_subsequence(a, b) == slow(a.tolist(), b.tolist())


def test_no_leak_is_lost_before_the_check(spark):
    """All windows and items by the check alone, with items far longer and shorter than a window."""
    m, rng = latent_decontamination, random.Random(4)
    text = lambda n: [f"t{rng.randrange(3000)}" if rng.random() < 0.6 else rng.choice(["the", "of", "and", "to"]) for _ in range(n)]
    items = [(i, text(n)) for i, n in enumerate([2, 6, 12, 15, 18, 20, 22, 25, 40, 60, 300, 400, 600, 600] * 2)]
    docs = []
    for d in range(140):
        words, item = text(rng.randrange(5, 300)), items[d % 28][1]
        if d % 5 == 1:  # half of the words in order and the answer
            item = [w if i >= len(item) - 4 or rng.random() < 0.5 else f"u{rng.randrange(999)}" for i, w in enumerate(item)]
        if d % 5 == 2:
            item = [w for w in item if rng.random() < 0.75]
        if d % 5 < 4:
            words[len(words) // 2 : len(words) // 2] = item
        docs.append((d, " ".join(words)))
    got = {r.doc_id: r for r in m.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()}
    hashed = lambda x: tokens.words(*tokens.text_buffer(pa.array([x])), tokens.MARKS)[0]
    hashes = [hashed(" ".join(w)) for _, w in items]
    for d, x in docs:
        h, want = hashed(x), []
        for i, item in enumerate(hashes):
            for first in range(0, max(1, len(h) - m.WINDOW + m.STRIDE), m.STRIDE):
                region = h[max(0, first - len(item)) : first + m.WINDOW + len(item)]
                found = m.common_subsequence(item, region) / len(item)
                if found >= 0.7 or found >= 0.5 and m.answered(item, region):
                    want.append(i)
                    break
        assert got[d].item_ids == want, d


def test_latent_space_is_smaller_than_its_passages(spark):
    """A text that shares no word with an item is near it by words that go together with its own."""
    m = latent_decontamination
    p, q, r = (" ".join(f"{x}{i}" for i in range(10)) for x in "pqr")
    docs, bench = spark.createDataFrame([(1, p), (2, q), (3, r), (4, "else")], "doc_id long, text string"), spark.createDataFrame([(0, f"{p} {q}"), (1, f"{q} {r}")], "item_id long, text string")
    (ids, texts), = m.item_blocks(bench, "item_id", "text")
    items = m.prepared(docs, ids, texts)
    assert items.latent.shape == (2, 1)
    h, _, at = tokens.words(*tokens.text_buffer(pa.array([r])), tokens.MARKS)
    near = {i: cosine for _, _, i, cosine in m.candidates(h, at, items)}
    assert near[0] == pytest.approx(3 / 2**0.5 / 6, abs=0.01)  # the plain cosine is 0
    got = {x.doc_id: x for x in m.find_leaks(docs, bench).collect()}
    assert got[3].cosine == pytest.approx(max(near.values())) and got[4].cosine == 0


def test_latent_candidates_hold_most_leaks(spark):
    m = latent_decontamination
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    (ids, texts), = m.item_blocks(bench, "item_id", "text")
    items = m.prepared(docs, ids, texts)
    assert items.latent.shape[1] <= len(items.owner) // 2
    leaks = {(r.doc_id, i) for r in m.find_leaks(docs, bench).collect() for i in r.item_ids}
    found = set()
    for row in docs.select("doc_id", "text").collect():
        h, _, at = tokens.words(*tokens.text_buffer(pa.array([row.text])), tokens.MARKS)
        for _, first, i, _ in m.candidates(h, at, items):
            n = len(texts[i])
            if m.accepted(texts[i], h[max(0, first - n) : first + m.WINDOW + n])[0]:
                found.add((row.doc_id, ids[i]))
    assert found <= leaks and len(leaks) > 5 and len(found) >= 0.9 * len(leaks)


def test_block_sent_to_tasks_is_small(spark):
    """No matrix of words and dimensions passes through the driver."""
    m = latent_decontamination
    docs, bench = (spark.read.parquet(f"/root/testdata/{t}.parquet") for t in ("sf0.001/documents", "sf0.1/benchmark"))
    (ids, texts), = m.item_blocks(bench, "item_id", "text")
    items = m.prepared(docs, ids, texts)
    assert len(items.words) > 3000 and len(pickle.dumps(items)) < 1_500_000
