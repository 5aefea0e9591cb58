"""SentencePiece ids against the library, and fill-in-middle texts against slicing."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grainwise.llm import fill_in_middle, prefix_tokens, tokens

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
OWN = prefix_tokens.loaded(MODEL)


def same_as_library(texts):
    ids = OWN.encode(*tokens.text_buffer(pa.array(texts, pa.string())))
    want = [LIBRARY.encode(t or "", add_bos=True, add_eos=True) for t in texts]
    assert [x.tolist() for x in ids] == want
    assert [OWN.decode(x) for x in want] == [LIBRARY.decode(x) for x in want]


@given(st.lists(st.text(alphabet="abcdeé   ▁\n\t\x00stinrh.<>/0x漢ß́😀-=#A", max_size=60), min_size=1, max_size=8))
@settings(max_examples=300, deadline=None)
def test_ids_are_those_of_the_library(texts):
    same_as_library(texts)


@given(st.lists(st.lists(st.sampled_from(OWN.table.text), max_size=10).map("".join), min_size=1, max_size=6))
@settings(max_examples=300, deadline=None)
def test_ids_of_joined_pieces_are_those_of_the_library(texts):
    same_as_library(texts)


def test_ids_of_odd_texts():
    texts = [None, "", " ", "▁", "<s></s><unk><0x0A>", "a" * 5000, "\n" * 700, "ab12" * 400 + " x", "漢字" * 900, "﻿​　 x"]
    same_as_library(texts + [" " * k + "x" + " " * k for k in range(70)])


@given(st.lists(st.one_of(st.sampled_from([0, 1, 2, 28705, 259, 264, 13, 195, 198, 143]), st.integers(0, 31999), st.integers(3, 258)), max_size=12))
@settings(max_examples=400, deadline=None)
def test_any_ids_are_decoded_as_by_the_library(ids):
    assert OWN.decode(ids) == LIBRARY.decode(ids)


def test_caches_begin_anew(monkeypatch):
    monkeypatch.setattr(prefix_tokens, "CACHE_RUNS", 5)
    monkeypatch.setattr(prefix_tokens, "CACHE_PAIRS", 5)
    for i in range(6):
        same_as_library([f"some words {i} and others {i * 7}", "é" * 400, "some words again"])
    OWN.forget()


def test_last_token_of_each_prefix_is_the_last_token_of_its_encoding():
    run = "▁unbelievabler"
    last = OWN.table.last_tokens(run)
    for i in range(1, len(run) + 1):
        assert OWN.table.text[last[i - 1] >> 16] == OWN.table.merged(run[:i])[-1]


def test_token_digests_of_tables(spark, odd, none, sf):
    docs = odd.unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), allowMissingColumns=True).selectExpr("*", "1 as ids", "2 as decoded", "3 as n_tokens", "4 as ids_sha256")
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = LIBRARY.encode(r.text or "", add_bos=True, add_eos=True)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()))
    got = [tuple(r) for r in prefix_tokens.digests(docs, MODEL).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    whole = prefix_tokens.encode(docs, MODEL)
    assert whole.where(F.col("n_tokens") != F.size("ids")).count() == 0
    assert sorted(r.decoded for r in whole.collect()) == sorted((r.text or "").replace("▁", " ") for r in docs.select("text").collect())
    assert prefix_tokens.digests(none, MODEL).count() == 0


def by_slicing(key, text):
    t = text or ""
    n = len(t)
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return key, n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return key, n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return key, n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


def test_fill_in_middle_equals_slicing(spark, odd, none, sf):
    docs = odd.unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), allowMissingColumns=True)
    more = [(1000 + i, t) for i, t in enumerate(["<P", "x<S>", "<<M>>", "<P <S <M", "é<", "a" * 40_000, "é" * 40_000, "漢<P>" * 9000, "\n<\n", "<PP>", "".join(chr(33 + i * i % 900) for i in range(30_000))] * 9)]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True).selectExpr("*", "1 as form", "2 as output", "3 as key", "4 as prefix_chars")
    got = fill_in_middle.transform(docs, seed="1").withColumn("restored", fill_in_middle.restored(F.col("output"), F.col("form")))
    rows = [tuple(r) for r in got.collect()]
    want = [(*by_slicing(r.doc_id, r.text), r.text or "") for r in docs.select("doc_id", "text").collect()]
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert {r[2] for r in rows} == {"plain", "psm", "spm"}
    assert fill_in_middle.transform(none, seed="1").count() == 0


@given(st.lists(st.text(alphabet="<PSM>é漢 a", max_size=900).map(lambda t: t * 7), min_size=1, max_size=5), st.integers(1, 6))
@settings(max_examples=120, deadline=None)
def test_chunks_measure_texts_however_they_are_cut(texts, bits):
    kept = fill_in_middle.BITS, fill_in_middle.LEAST, fill_in_middle.LONGEST
    fill_in_middle.BITS, fill_in_middle.LEAST, fill_in_middle.LONGEST = bits, 2, 40
    try:
        data, offsets = tokens.text_buffer(pa.array(texts, pa.string()))
        cache = fill_in_middle.ChunkCache(most=3000)
        for t, ends in zip(texts, fill_in_middle.boundaries(data, offsets), strict=True):
            own = fill_in_middle.Measured.of(t.encode(), ends, cache)
            assert own.characters == len(t) and own.marked == any(s in t for s in ("<P>", "<S>", "<M>"))
            assert [own.byte_of(i) for i in range(0, len(t) + 1, 7)] == [len(t[:i].encode()) for i in range(0, len(t) + 1, 7)]
            assert (np.diff([0, *ends])[:-1] >= 2).all()
    finally:
        fill_in_middle.BITS, fill_in_middle.LEAST, fill_in_middle.LONGEST = kept


def test_copies_share_their_chunks():
    passage = " ".join(f"word{i * 31 % 977}" for i in range(6000))
    texts = [passage, "something before " + passage, passage + " something after"]
    cache = fill_in_middle.ChunkCache()
    data, offsets = tokens.text_buffer(pa.array(texts))
    for t, ends in zip(texts, fill_in_middle.boundaries(data, offsets), strict=True):
        fill_in_middle.Measured.of(t.encode(), ends, cache)
    assert cache.hits > 1.7 * cache.misses
    assert cache(texts[0][:100].encode()) == fill_in_middle.Summary.of(texts[0][:100].encode()) or pytest.fail("a summary is not that of its content")
