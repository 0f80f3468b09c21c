"""Packing, secrets, BPE, HTML, lines, licences, neighbours."""

import base64
import bz2
import gzip
import random
import re
import time
import urllib.parse
import zlib
from collections import Counter
from html.parser import HTMLParser

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ampflow.llm import ann, bpe, html, licenses, lines, packing, secrets

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def other():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


# BPE ----------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab c\n\t  é漢'sdll!12½\x1c |")), max_size=60))
def test_bpe_equals_the_library(other, text):
    own = bpe.encoder(RANKS, P.PATTERN)
    ids = own.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


def test_bpe_of_long_runs(other):
    own = bpe.encoder(RANKS, P.PATTERN)
    for text in ("ab" * 5000, "aaaa" * 3000, "的" * 999, "x" * 5000):
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == other.encode_ordinary(text)


def test_bpe_round_trip_of_a_table(docs, corpus, nothing):
    ids = bpe.encode(docs, RANKS, P.PATTERN)
    back = sorted(((r.doc_id, r.text) for r in bpe.decode(ids, RANKS, P.PATTERN).collect()), key=str)
    assert back == sorted(((r[0], r[1] or "") for r in corpus), key=str)
    rows = bpe.digest(docs, RANKS, P.PATTERN).collect()
    assert len(rows) == len(corpus) and {r.n_tokens for r in rows if r.doc_id in (200, 201)} == {0}
    assert bpe.digest(nothing, RANKS, P.PATTERN).count() == 0


# Packing ------------------------------------------------------------------


def test_packing_holds_every_id_once(docs, corpus, nothing):
    path = P.path("byte_bpe_50k.tiktoken")
    rows = packing.pack_documents(docs.coalesce(1), path, P.PATTERN).collect()
    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    expected = {}
    for r in corpus:
        ids = own.encode(r[1] or "", add_special_tokens=False).ids + [0]
        expected.setdefault(r[0], []).append(ids)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == set(expected)
    for doc, texts in expected.items():
        if len(texts) == 1:
            at = 0
            for r in sorted(by[doc], key=lambda r: r.start):
                part = np.array(texts[0][r.start : r.start + r.length], "<u4").tobytes()
                assert r.start == at and r.ids_crc32 == zlib.crc32(part) and r.doc_tokens == len(texts[0])
                at += r.length
            assert at == len(texts[0])
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append(r)
    fills = []
    for pieces in windows.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        fills.append(at)
    assert max(fills) <= 1024 and sum(f < 1024 for f in fills) <= 1
    assert packing.pack_documents(nothing, path, P.PATTERN).count() == 0


def test_level_choice_is_the_least_sum_of_squares():
    """Of all levels, those that a cut fills up included, at the cut's price."""
    rng = random.Random(1)
    levels = packing.Levels(16)
    for _ in range(300):
        size = rng.randint(1, 15)
        count = levels.count.copy()

        def after(h):
            c = count.copy()
            if h:
                c[h] -= 1
            if (h + size) % 16:
                c[(h + size) % 16] += 1
            return int((c[1:16] ** 2).sum()) + packing.CUT * (h + size > 16)

        options = [0] + [h for h in range(1, 16) if count[h]]
        assert after(levels.best(size)) == min(map(after, options))
        for window in levels.place((0, 0, b"\0" * 4 * size, size)):
            assert sum(len(ids) // 4 for _, _, ids, _ in window) == 16
        assert levels.open == levels.count.sum()


@pytest.mark.parametrize(("low", "high"), [(600, 600), (600, 1000), (1, 1023), (513, 520)])
def test_windows_are_closed_by_the_rule(low, high):
    """Open windows stay few whatever the lengths, and what the last fill closes is a small share."""
    rng = random.Random(7)
    levels, closed = packing.Levels(), 0
    for i in range(8000):
        closed += sum(1 for _ in levels.place((i, 0, bytes(4 * rng.randint(low, high)), 0)))
        assert levels.open <= packing.WINDOW
    assert levels.open < 0.07 * (closed + levels.open)
    got = [w for w in packing.pack(((i, b"\1\0\0\0" * 600) for i in range(200))) if w is not None]
    assert sum(len(p[2]) for w in got for p in w) == 200 * 2400
    assert sum(sum(len(p[2]) // 4 for p in w) < 1024 for w in got) <= 1


# Secrets ------------------------------------------------------------------

SECRET = 'token = "abcdefghijklmnop12"'


def kinds(text):
    return [(secrets.KINDS[k], text[a:b]) for a, k, b in secrets.find(text)[1]]


@pytest.mark.parametrize("pack", [bytes, gzip.compress, zlib.compress, bz2.compress, zstandard.compress, lambda b: base64.b64encode(gzip.compress(b)), lambda b: urllib.parse.quote(b).encode()])
def test_secrets_in_layers(pack):
    inner = base64.b64encode(pack(SECRET.encode())).decode()
    assert ("assign" in dict(kinds(f"see {inner} here"))) and inner.startswith(dict(kinds(f"see {inner} here"))["assign"][:8])


def test_escapes_map_back():
    assert kinds('é password\\u003d"hunter2hunter2"') == [("assign", 'password\\u003d"hunter2hunter2')]
    assert kinds("a %74oken%3Dabcdefghijklmn b") == [("assign", "%74oken%3Dabcdefghijklmn")]
    assert kinds(urllib.parse.quote(urllib.parse.quote(base64.b64encode(SECRET.encode()).decode())))[0][0] == "assign"


def test_base_spans_are_the_plain_patterns(corpus):
    rng = random.Random(2)
    bits = ["token=", "secret:", "api_key = ", "AKIA", "ABCDEF12", "deadbeef", "0123456789abcdef", "password", '"', " ", "xyz", "TOKEN"]
    for _ in range(800):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 12)))
        plain = []
        for k, (p, g, n) in enumerate(((secrets.ASSIGN, 2, 12), (re.compile("AKIA[A-Z0-9]+"), 0, 18), (re.compile("[0-9a-f]+"), 0, 16))):
            plain += [(m.start(), k, m.end()) for m in p.finditer(text) if len(m[g]) >= n]
        base, every = secrets.find(text)
        assert base == sorted(plain) and set(base) <= set(every)


def test_cycles_and_bombs_end():
    text = "%25" * 50 + "41"
    for _ in range(4):
        text = urllib.parse.quote(text)
    secrets.find(text)
    assert kinds("%" + "25" * 200_000 + "41")[0][0] == "hex"
    assert kinds("%5Cu0025" + "5Cu0025" * 30_000 + "74oken=abcdefghijklmn")[0][0] == "assign"


def test_secret_table(docs, corpus, nothing, nulls):
    rows = secrets.scans(docs.withColumn("text", F.when(F.col("doc_id") == 5, F.lit(SECRET)).otherwise(F.col("text")))).collect()
    assert len(rows) == len(corpus)
    assert {(r.n_assign, r.spans) for r in rows if r.doc_id == 5} == {(1, f"assign:0:{len(SECRET) - 1}")}
    assert {r.spans for r in rows if r.doc_id in (200, 201)} == {""}
    assert secrets.scans(nothing).count() == 0 and secrets.scans(nulls).count() == 2
    clean = secrets.redact(docs.withColumn("text", F.concat(F.lit(SECRET + " and "), F.col("text")))).where("doc_id = 201").first()
    assert clean.text == '[SECRET]" and '


# HTML ---------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>One<p>Two &amp; <b>bold</b><br>next", "One\n\nTwo & bold\nnext"),
        ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>", "- a\n- b\n  3. x\n  4. y\n- c"),
        ("<table><tr><th>Name<th>Qty<tr><td>apple<td>1<tr><td colspan=2>wide</table>", "Name   Qty\napple  1\nwide"),
        ("<td>x</td><table><td>a<td>b</table>", "x\n\na  b"),
        ("a<script>var x='<p>'</script>b<style>p{}</style><!-- no --><div hidden>c</div><div style='display: none'>d</div>", "ab"),
        ("<pre>  keep\n   this</pre>tail", "  keep\n   this\n\ntail"),
        ("<title>t</title><body>x < y <3", "x < y <3"),
        ("<details><summary>S</summary>no</details><details open><summary>T</summary>yes</details>", "S\nT\nyes"),
        ("", ""),
        ("<div>" * 5000 + "deep", "deep"),
        ("<!-- never ends", ""),
        ("<table><tr><td rowspan=2>A<td>b<tr><td>c<tr><td>d<td>e</table>", "A  b\n   c\nd  e"),
        ("<table><tr><td><p>A<p>B<td>b</table>tail", "A  b\n\nB\n\ntail"),
        ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b></div>", "yes"),
        ("<style>.h, p.x {display:none} @media print{b{display:none}} #q{visibility:hidden}</style><i class='a h'>1</i><b>2</b><p class=x>3</p><div id=q>4</div>", "2"),
        ("<div style='display:none'>no<b style='display:inline'>no</b></div>yes", "yes"),
    ],
)
def test_html_layout(page, text):
    assert html.extract(page) == text


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "<p>a"), (2, None), (None, ""), (1, "<p>a")], "page_id long, html string")
    assert sorted(((r.page_id, r.text) for r in html.extract_text(pages).collect()), key=str) == sorted([(1, "a"), (1, "a"), (2, None), (None, "")], key=str)


def test_html_depth_is_linear():
    began = time.time()
    assert html.extract("<p>a" + "<div>" * 100_000 + "x") == "a\n\nx"
    assert html.extract(" <br>" * 100_000 + "x") == "x"
    assert time.time() - began < 30


class Seen(HTMLParser):
    """The words of a page outside elements that show nothing, without layout."""

    def __init__(self):
        super().__init__()
        self.inside, self.words = [], []

    def handle_starttag(self, tag, attrs):
        said = dict(attrs)
        hidden = tag in ("head", "script", "style", "noscript", "template", "svg") or "hidden" in said or "none" in (said.get("style") or "")
        if (hidden or self.inside) and tag not in html.VOID:
            self.inside.append(tag)

    def handle_endtag(self, tag):
        if tag in self.inside:
            del self.inside[len(self.inside) - 1 - self.inside[::-1].index(tag) :]

    def handle_data(self, data):
        if not self.inside:
            self.words.append(data)


def test_html_words_are_those_of_another_parser(spark):
    rows = html.extract_text(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).alias("t").join(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").alias("p"), "page_id").collect()
    assert rows
    for r in rows:
        other = Seen()
        other.feed(r.html)
        other.close()
        ours, theirs = (Counter("".join(x.split())) for x in (r.text, "".join(other.words)))
        assert not theirs - ours and set(ours - theirs) <= set("-.0123456789"), r.page_id  # bullets and numbers of lists


def test_html_extra_columns_and_no_rows(spark):
    pages = spark.createDataFrame([(1, "<p>a", "x", "y")], "page_id long, html string, text string, n_chars string")
    assert [tuple(r) for r in html.extract_text(pages).collect()] == [(1, "a")]
    assert html.extract_text(pages.where("page_id > 1")).count() == 0


# Lines --------------------------------------------------------------------


def slow_repeats(words):
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    return len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)})


def test_repeated_words():
    rng = random.Random(3)
    for _ in range(300):
        words = [rng.choice(["a", "b", "c"]).encode() for _ in range(rng.randint(0, 60))]
        assert lines.repeated_words(words) == slow_repeats(words)


def test_line_rules(docs, corpus, nothing, nulls):
    rows = lines.rules(docs).collect()
    assert len(rows) == len(corpus)
    got = {r.doc_id: r for r in rows}
    assert got[200].n_words == 0 and got[200].base_failed and not got[200].kept
    assert got[204].base_failed and got[204].n_repeat_words == 60000
    text = dict((r[0], r[1]) for r in corpus)[6]
    assert got[6].word_chars == len(re.sub(r"[\x20\x09-\x0D]", "", text)) and got[6].n_words == len(text.split())
    assert lines.rules(nothing).count() == 0 and lines.rules(nulls).count() == 2


def test_boilerplate_is_counted_by_host(spark):
    own = " ".join(f"w{k}" for k in range(30))
    rows = [(i, "a", f"Shared LINE  here\n{own} {i}") for i in range(40)] + [(100 + i, "a", "shared line here\n" * 12 + own) for i in range(2)] + [(200, "b", "shared line here " + own)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r for r in lines.rules(docs).collect()}
    assert got[0].removed_words == 3 and got[0].kept and got[200].removed_words == 0
    assert got[100].removed_words == 36 and not got[100].kept
    clean = {r.doc_id: r.text for r in lines.without_boilerplate(docs).collect()}
    assert clean[0] == f"{own} 0" and clean[200].startswith("shared")
    assert set(clean) == {i for i, r in got.items() if r.kept}


def test_both_ways_of_line_rules_know_the_same_lines(spark):
    own = " ".join(f"w{k}" for k in range(30))
    rows = [(i, "a", f"no\u00a0break {'here' if i % 2 else 'HERE'}\n\n{own} {i}") for i in range(40)] + [(50, "a", f"no break here\n{own}")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert {r.doc_id: r.removed_words for r in lines.rules(docs).collect()} == {i: 2 * (i < 50) for i, *_ in rows}
    assert {r.doc_id: r.text for r in lines.without_boilerplate(docs).collect()} == {i: f"\n{own} {i}" if i < 50 else t for i, _, t in rows}


def test_line_counts_by_hand(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice("aaab"), "\n".join([" ".join(f"u{i}w{k}" for k in range(25))] + [f"line {rng.randint(0, 6)}  Foot" for _ in range(rng.randint(0, 9))])) for i in range(60)]
    held = {}
    for _, host, text in rows:
        for line in {" ".join(x.split()).lower() for x in text.split("\n")}:
            held[host, line] = held.get((host, line), 0) + 1
    want = {i: sum(len(x.split()) for x in text.split("\n") if held[host, " ".join(x.split()).lower()] > 10) for i, host, text in rows}
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert {r.doc_id: r.removed_words for r in lines.rules(docs).collect()} == want and any(want.values())


# Licences -----------------------------------------------------------------


def test_licence_rules_and_sql(spark, docs, corpus, nothing):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. The above copyright notice and this permission notice shall be included in all copies. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND. In no event shall the authors or copyright holders be liable."
    extra = [(900, mit), (901, "Foo.\nLicensed under the Apache License,\nVersion 2.0. Bar"), (902, "Licensed under the Foo terms."), (903, "This work is licensed under the GNU General Public License, version 3."), (904, "Released under the MIT License. Licensed under CC BY-NC 4.0.")]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = [tuple(r) for r in licenses.scan(table).collect()]
    got = {r[0]: r for r in rows}
    assert [got[i][5] for i in (900, 901, 902, 903, 904)] == ["MIT", "Apache-2.0", "unknown", "GPL-3.0", "MIT"]
    assert got[904][3] == "MIT CC-BY-NC" and got[902][4] == "OtherRef" and got[200][5] == "none"
    con = duckdb.connect()
    con.register("documents", table.toPandas().astype({"doc_id": "Int64"}))
    assert sorted(con.execute(licenses.SQL).fetchall(), key=str) == sorted(rows, key=str)
    assert licenses.scan(nothing).count() == 0


# Neighbours ---------------------------------------------------------------


def test_neighbours_recall_and_edges(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16)).astype("float32")
    x[500:1500] = x[500]  # a third are one vector
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(9000, None), (9100, []), (9200, [0.0] * 16), (9300, [float("nan")] * 16), (9400, [1.0, None] * 8), (9500, [1.0] * 3), (None, [1.0] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    own = ann.valid(table)
    got = ann.search(own, own.where("pmod(vec_id, 100) = 0")).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(by) == set(range(0, 3000, 100)) and all(len(v) == 10 for v in by.values())
    hits, x = 0, x.astype(float)
    for q, found in by.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(x)), d))[:10]
        hits += len({v for v, _ in found} & set(best.tolist()))
        assert all(abs(s - d[v]) < 1e-9 for v, s in found) and found == sorted(found, key=lambda p: (p[1], p[0]))
    assert hits / (10 * len(by)) >= 0.9
    assert [v for v, _ in by[600]] == [500 + i for i in range(10)]


def test_few_or_no_vectors(spark):
    mixed = ann.valid(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [1.0]), (100, [3.0]), (100, [3.0])], "vec_id long, embedding array<double>"))
    found = ann.search(mixed, mixed.where("pmod(vec_id, 100) = 0")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in found] == [(0, 1, 2, 1.0), (0, 2, 1, 2**0.5), (100, 1, 3, 2.0)]
    few = ann.valid(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>"))
    got = [(r["rank"], r.vec_id) for r in ann.search(few, few.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(1, 2), (2, 1)]
    none = few.where("vec_id > 5")
    assert ann.search(none, none).count() == 0


def test_recall_on_the_given_vectors(spark):
    table = ann.valid(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"))
    rows = table.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.v for r in rows], float)
    by = {}
    for r in ann.search(table, table.where("pmod(vec_id, 100) = 0")).collect():
        by.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(by) == {int(i) for i in ids if i % 100 == 0}
    hits = 0
    for q, found in by.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        hits += len(found & set(ids[np.lexsort((ids, d))[:10]].tolist()))
    assert hits / (10 * len(by)) >= 0.9
