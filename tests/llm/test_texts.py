"""Licences, WARC records, packing and the pipeline."""

from __future__ import annotations

import gzip
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from grainwise.llm import license_digests, sos_packing, tokens, warc_derivatives

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@given(st.lists(st.text(alphabet="aB'sé .,!|<>0₂9\t\n\x0b ́İς漢», ", max_size=40), min_size=1, max_size=8))
@settings(max_examples=150, deadline=None)
def test_words_are_cut_and_hashed_as_python_does(texts):
    h, starts, at = tokens.words(*tokens.text_buffer(pa.array(texts)))
    words = [w for t in texts for w in t.encode().lower().split()]
    assert np.diff(at).tolist() == [len(t.encode().split()) for t in texts]
    number: dict = {}
    assert [number.setdefault(w, x) == x for w, x in zip(words, h.tolist(), strict=True)] == [True] * len(words)
    assert len(set(number.values())) == len(number)


@given(st.lists(st.text(alphabet="aB'sé .,!|<>0₂9\t\n\x0b ́İς漢», ", max_size=40) | st.sampled_from(["<|endoftext|>.,", "x<|startoftext|>'s!", "don't.. ok's,"]), min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_ids_of_words_are_ids_of_texts(texts):
    encode = sos_packing.WordEncoder(VOCABULARY)
    got = encode(*tokens.text_buffer(pa.array(texts)))
    assert [x.tolist() for x in got] == [encode.model.encode(t, add_special_tokens=False).ids for t in texts]


def check_packing(pieces, rows):
    """Every id in one piece, sequences without gaps; returns the share of padding."""
    model = Tokenizer.from_file(VOCABULARY)
    want = sorted(([*model.encode(t or "", add_special_tokens=False).ids, 1] for _, t in rows), key=str)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for doc, ids in ((d, [*model.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in rows):
        own = [p for p in by_doc[doc] if p.doc_tokens == len(ids)]
        covered = defaultdict(int)
        for p in own:
            covered[p.start] += 1
        assert covered and sum(p.length for p in own) % len(ids) == 0
        for p in own:
            assert 0 < p.length <= len(ids) - p.start
            assert doc is None or zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
    padding = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    total = sum(map(len, want))
    assert sum(p.length for p in pieces) == total
    return padding / max(1, total)


def test_packing_round_trip(spark, odd, none, sf):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    check_packing(sos_packing.pack(odd, VOCABULARY).collect(), rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(4, "doc_id")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert check_packing(sos_packing.pack(docs, VOCABULARY).collect(), rows) == 0
    assert check_packing(sos_packing.pack(docs, VOCABULARY, most_open=3).collect(), rows) == 0
    assert sos_packing.pack(none, VOCABULARY).count() == 0


def test_packer_takes_the_least_sum_of_squares():
    rng = np.random.RandomState(5)
    packer, window = sos_packing.Packer(20, 10**6, 0), 20
    count = np.zeros(window + 1, int)
    for doc, size in enumerate(rng.randint(1, 20, size=300)):
        best = None
        for level in [h for h in range(window - size, 0, -1) if count[h]] + [0]:
            after = count.copy()
            after[level] -= level > 0
            if level + size < window:
                after[level + size] += 1
            squares = (after[1:window] ** 2).sum()
            if best is None or squares < best[0]:
                best = squares, after
        count = best[1]
        packer.add(doc, np.arange(size, dtype=np.uint32))
        assert (packer.count[1:window] ** 2).sum() == (count[1:window] ** 2).sum()
        count = packer.count.copy()
    packer.join(last=True)
    assert sum(r[2] for r in packer.rows) == sum(len(range(r[4])) for r in {r[0]: r for r in packer.rows}.values())


def test_license_digests(spark, odd, none):
    known = license_digests.known_licenses(spark)
    mit = license_digests.KNOWN_TEXTS[0][1]
    variant = "Copyright (c) 2020 Some Body\nCOPYRIGHT 1999\n\n" + mit.upper().replace("SUBLICENSE", "sub-licence").replace('"', "“")
    rows = [(1, variant), (2, mit + " but not quite"), (3, "prose\nLICENCED under the Apache Licence -- version 2.0\nReleased under the MIT License!\nReleased under the MIT License."), (4, None), (5, "(c) 2001 x\nAll rights reserved."), (6, "")]
    got = {r.doc_id: (r.license_id, r.notices, r.n_notice_lines) for r in license_digests.scan(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()}
    assert got[1][0] == "MIT" and got[2][0] is None
    assert got[3] == (None, "Apache-2.0,MIT", 3) and got[4] == got[5] == got[6] == (None, None, 0)
    assert license_digests.scan(odd, known).count() == odd.count() and license_digests.scan(none, known).count() == 0
    quick = license_digests.scan(spark.createDataFrame(rows, "doc_id long, text string"), known, telling=license_digests.TELLING)
    assert {r.doc_id: (r.license_id, r.notices, r.n_notice_lines) for r in quick.collect()} == got
    assert all(any(w in t.lower() for w in license_digests.TELLING) for _, t in license_digests.KNOWN_TEXTS + license_digests.NOTICES)


def test_neighbouring_spellings_are_levelled_each(spark):
    texts = ["licence licence licenced", "Non-Commercial non commercial", "sub licence sub-license", "per cent per cent", "copyright law\nhere", "(C) 1999 x\ny"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in df.select(license_digests.canonical(df["text"])).collect()]
    assert got == ["license license licensed", "noncommercial noncommercial", "sublicense sublicense", "percent percent", "here", "y"]


def test_whole_texts_and_notices_of_common_licenses(spark):
    folder = Path("/usr/share/common-licenses")
    rows = [(a, (folder / f).read_text()) for a, f in (("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")) if (folder / f).exists()]
    two = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
    end = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
    three = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
    rows += [("BSD-2-Clause", f"BSD 2-Clause License\n\nCopyright (c) 2024, A\n\n{two}{end}"), ("BSD-3-Clause", f"Copyright (c) 2024, A\nAll rights reserved.\n\n{two}{three}{end}")]
    rows += [("notice BSD-3-Clause", "prose\nLicensed under the BSD 3-Clause License."), (None, f"{two}{end} And more.")]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_digests.scan(docs, license_digests.known_licenses(spark)).collect()}
    for i, (name, _) in enumerate(rows):
        if name and name.startswith("notice "):
            assert got[i].license_id is None and got[i].notices == name.removeprefix("notice ")
        else:
            assert got[i].license_id == name


def test_warc_records(spark, tmp_path):
    html = '<html lang="en"><head><title>A &amp; B</title><script>var x="<p>";</script></head><body><!-- no --><p>One &lt;two&gt;</p><div>three  four<br>five</div><a href="/x">link</a><a class="c" href="http://y/">y</a></body></html>'
    rows = [(1, "http://a/", html, "clash"), (2, None, None, None), (3, "http://b/", "", "x"), (1, "http://a/", html, "clash"), (None, "http://c/", "plain " * 50_000, "x")]
    source = warc_derivatives.responses(spark.createDataFrame(rows, "page_id long, url string, html string, block string"), "2025-01-01T00:00:00Z")
    ids = {r.page_id: r.record_id for r in source.collect()}
    records = warc_derivatives.derive(source)
    got = records.collect()
    assert len(got) == 2 * len(rows) and all(r.refers_to == ids[r.page_id] for r in got)
    text = {(r.page_id, r.record_type): r.block for r in got}
    assert text[1, "conversion"] == "A & B\nOne <two>\nthree four\nfive\nlinky"
    assert text[1, "metadata"] == "title: A & B\r\nlanguage: en\r\noutlink: /x\r\noutlink: http://y/\r\n"
    assert text[2, "conversion"] == text[3, "conversion"] == text[2, "metadata"] == ""
    warc_derivatives.write_warc(records, str(tmp_path / "w"))
    data = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path, "w").glob("*.gz"))
    blocks, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        size = int(head["Content-Length"])
        blocks.append((head["WARC-Record-ID"], data[end + 4 : end + 4 + size].decode()))
        assert head["X-Source-Payload-Digest"].startswith("sha256:") and data[end + 4 + size : end + 8 + size] == b"\r\n\r\n"
        at = end + 8 + size
    assert sorted(blocks) == sorted((r.record_id, r.block) for r in got)
    assert warc_derivatives.derive(warc_derivatives.responses(spark.createDataFrame([], "page_id long, url string, html string"), "x")).count() == 0


def test_warc_records_decode_all_references_and_read_all_quotes(spark):
    page = """<html class=a lang='de'><head><title>Caf&eacute; &amp; &#x201C;B&#8221;&#10;x</title></head><body><p>&copy; 2020 &middot; a&nbsp;b &hellip; &amp;lt;</p><a data-href="no" href='/one?a=1&amp;b=2'>1</a><a class=c href=/two>2</a><a href="/it's">3</a><a href="">4</a></body></html>"""
    source = warc_derivatives.responses(spark.createDataFrame([(1, "u", page), (2, "u", None)], "page_id long, url string, html string"), "x")
    got = {(r.page_id, r.record_type): r.block for r in warc_derivatives.derive(source).collect()}
    assert got[1, "conversion"] == "Caf\u00e9 & \u201cB\u201d\nx\n\u00a9 2020 \u00b7 a b \u2026 &lt;\n1234"
    assert got[1, "metadata"] == "title: Caf\u00e9 & \u201cB\u201d x\r\nlanguage: de\r\noutlink: /one?a=1&b=2\r\noutlink: /two\r\noutlink: /it's\r\noutlink: \r\n"
    assert got[2, "conversion"] == got[2, "metadata"] == ""


def test_warc_references_and_bare_signs(spark):
    want = {
        "x < y and 3 > 2": "x < y and 3 > 2",
        "a <b>c</b> <!doctype x>d<?php e?>f </p>g": "a c df\ng",
        "&lt;b&gt; &amp;amp; &AMP; &notanentity; & &; &#; &#x;": "<b> &amp; & \u00acanentity; & &; &#; &#x;",
        "&#0; &#128; &#x9F; &#129; &#xD800; &#1114112; &#x1F600; &#00065;": "\ufffd \u20ac \u0178 \x81 \ufffd \ufffd \U0001f600 A",
        "&copy 2020 &copyright &eacutex &NotEqualTilde; &hearts; &bne;": "\u00a9 2020 \u00a9right \u00e9x \u2242\u0338 \u2665 =\u20e5",
        "AT&T R&D &nbsp&#160;&nbsp;end&": "AT&T R&D end&",
    }
    source = warc_derivatives.responses(spark.createDataFrame([(i, "u", x) for i, x in enumerate(want)], "page_id long, url string, html string"), "x")
    got = {r.page_id: r.block for r in warc_derivatives.derive(source).where("record_type = 'conversion'").collect()}
    assert [got[i] for i in range(len(want))] == list(want.values())
    page = '<a href="/a?b=1&copy=2&amp;lt=3&#10;4">x</a>'
    source = warc_derivatives.responses(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string"), "x")
    assert warc_derivatives.derive(source).where("record_type = 'metadata'").first().block == "outlink: /a?b=1&copy=2&lt=3 4\r\n"


@pytest.fixture(scope="module")
def staged(spark, sf, tmp_path_factory):
    import corpus_pipeline

    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, docs, sf).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return out


def test_pipeline_stages_equal_brute_force(spark, sf, staged):
    import re

    from test_joins import brute_components

    texts = [({r.doc_id: r.text for r in before.collect()}, after) for _, before, after in staged]
    for before, after in [(b, a) for _, b, a in staged][:4]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    (first, a1), (second, a2), (third, a3), (fourth, a4), (fifth, a5) = texts
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert not {d for d in set(first) - {r.doc_id for r in a1.collect()} if labels.get(d) == 0}
    seen: dict = {}
    for d in sorted(second):  # exact masked lines are the least that goes
        lines = [tuple(re.sub(r"[^ \t\r]*[0-9][^ \t\r]*", "<*>", x).split()) for x in second[d].split("\n")]
        left = third[d].split("\n")
        for x, key in zip(second[d].split("\n"), lines, strict=True):
            if key and seen.get(key, d) != d:
                assert x not in left
        for key in lines:
            seen.setdefault(key, d)
        assert all(x in second[d].split("\n") for x in left if x)
    want = {d for d, (_, root) in brute_components(list(third.items()), 5, 80, 100).items() if d == root}
    assert set(fourth) == want
    item = {r.item_id: re.findall(r"[^\W_]+", r.text.lower()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    body = {d: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " " for d, t in fourth.items()}
    leaky = {d for d, t in body.items() if any(" " + " ".join(w) + " " in t for w in item.values())}
    gone = set(fourth) - set(fifth)
    assert leaky <= gone and len(gone - leaky) <= 1
    assert check_packing(a5.collect(), list(fifth.items())) < 0.01


def test_pipeline_run_is_its_stages(spark, sf, staged):
    import corpus_pipeline

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    got = corpus_pipeline.run(spark, sf)
    assert got.groupBy("doc_id").agg({"length": "sum"}).count() == staged[-1][2].select("doc_id").distinct().count()
    assert set(columns) <= set(got.columns)


def test_encoder_holds_the_encodings_of_one_run():
    """Words by the thousand, more than are remembered and again, give the ids of the library."""
    encode = sos_packing.WordEncoder(VOCABULARY)
    whole, sizes = encode.model, []

    class Counted:
        def encode_batch_fast(self, texts, **rest):
            sizes.append(len(texts))
            return whole.encode_batch_fast(texts, **rest)

    encode.model = Counted()
    texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}" for i in range(a, a + 3000)) + " 10 <|x|>" for a in (0, 2000, 0)]
    for part in (texts, texts[::-1]):
        got = encode(*tokens.text_buffer(pa.array(part)))
        assert [x.tolist() for x in got] == [x.ids for x in whole.encode_batch(part, add_special_tokens=False)]
    assert len(sizes) > 5 and max(sizes) == 1
