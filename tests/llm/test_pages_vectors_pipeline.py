"""Pages, vectors and the pipeline."""

import base64
import gzip
import hashlib
import html
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallystream.llm import ann, htmltext, warc
from tallystream.llm.queries import word_vocabulary

SMALL = "/root/testdata/sf0.001"


def test_main_text_of_test_pages(spark):
    for d in (SMALL, "/root/testdata/sf0.01"):
        p = spark.read.parquet(f"{d}/pages.parquet")
        pages = {r.page_id: r.html for r in p.collect()}
        for r in htmltext.main_text(p).collect():
            body = pages[r.page_id].split("<article>")[1].split("</article>")[0]
            blocks = [" ".join(html.unescape(x).split()) for x in re.split(r"</?p>|<br>|</?h1>", body.replace("<b>", "").replace("</b>", ""))]
            assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
            # Differencing finds the menu, the advert and the footer of every page; nothing is left for the markup's own meaning.
            assert r.n_shared >= 3 and r.n_markup == 0


def test_neighbours_give_the_template_away(spark):
    page = "<body><div>Site name</div><div>Home | About</div><div>%s one</div><p>Own &lt;%s&gt;&nbsp;x</p><div>All rights</div><div class='comments'><p>bla</p></div><form>f</form></body>"
    rows = [(i, f"http://h.org/a/{i}", page % (i, i)) for i in range(5)] + [(9, None, None), (10, "http://x.org/", ""), (None, "http://[bad", "<p>x"), (11, "http://y.org/1", "<p>same</p><p>b"), (12, "http://y.org/2", "<p>same</p><p>b")]
    got = {r.page_id: r for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' as text", "'c' as row")).collect()}
    assert all(got[i].text == f"{i} one\nOwn <{i}> x" for i in range(5))
    assert got[9].text == got[10].text == "" and got[9].n_chars == 0 and got[None].text == "x"
    assert got[11].text == got[12].text == "same\nb"  # copies of each other are no template
    assert htmltext.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_text_outside_an_article_is_kept(spark):
    page = "<body><div>Site name</div><article><p>Teaser</p></article><div><p>Body %s</p><div>more of %s</div></div><div>All rights</div></body>"
    rows = [(i, f"http://h.org/a/{i}", page % (i, i)) for i in range(4)]
    got = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Teaser\nBody {i}\nmore of {i}" for i in range(4)}


def main_texts(spark, rows):
    return {r.page_id: r for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_containers_of_a_template_go_with_other_text_in_them(spark):
    def page(i):
        words = " ".join(f"w{i}x{k}" for k in range(30))
        notes = "".join(f"<p>note {i} {k}</p>" for k in range(i + 1))
        return (
            f"<body><div id='top-{i}'>Menu of {i}</div><div class='story'><h1>T{i}</h1><p>{words}</p><p>as all say</p></div><div class='said'>{notes}</div><div class='x'>advert {i}</div></body>",
            f"<article><h1>T{i}</h1><p>{words}</p><section class='q'>{notes}</section><article><p>by the standard a comment {i}</p></article></article><div class='x'>advert {i}</div>",
        )

    rows = [(10 * k + i, f"http://{'ab'[k]}.org/{i}", page(i)[k]) for i in range(4) for k in range(2)]
    got = main_texts(spark, rows)
    for i in range(4):
        words = " ".join(f"w{i}x{k}" for k in range(30))
        assert got[i].text == f"T{i}\n{words}\nas all say".replace("\nas all say", "")  # the line that neighbours share is no part of a page outside an article
        assert got[10 + i].text == f"T{i}\n{words}"


def test_a_page_alone_loses_what_html_defines(spark):
    got = main_texts(spark, [(1, "http://a.org/", "<nav>n</nav><aside>s</aside><p>kept</p><div class='ad'>unknown</div><form>f</form><footer>f</footer><p hidden>h")])
    assert (got[1].text, got[1].n_shared, got[1].n_markup) == ("kept\nunknown", 0, 4)


def test_long_pages_and_many_parts(spark, monkeypatch):
    long = "<p>" + "</p><p>".join(f"own line {i} of many" for i in range(60_000)) + "</p>"
    rows = [(i, f"http://h.org/{i:03}", f"<div>Site</div><div class='m'>menu {i}</div><article><p>the article of page {i}</p></article>" + (long if i == 7 else "")) for i in range(60)]
    monkeypatch.setattr(htmltext, "PART_BYTES", 100_000)
    many = main_texts(spark, rows)
    monkeypatch.setattr(htmltext, "PART_BYTES", 1 << 30)
    assert many == main_texts(spark, rows) and len(many) == 60
    assert all(r.text == f"the article of page {i}" for i, r in many.items() if i != 7) and many[7].text.count("\n") == 60_000


def test_shared_lines_is_a_longest_common_subsequence(monkeypatch):
    rng = np.random.default_rng(2)
    for bits in (1 << 26, 40):  # the second halves the lists
        monkeypatch.setattr(htmltext, "ROW_BITS", bits)
        for _ in range(300):
            a, b = (rng.integers(0, int(rng.integers(1, 9)), int(rng.integers(0, 22))).tolist() for _ in "ab")
            best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
            x, y = htmltext.shared_lines(a, b)
            assert len(x) == len(y) == best[-1][-1] and [a[i] for i in x] == [b[j] for j in y] and x == sorted(set(x)) and y == sorted(set(y))
    assert len(htmltext.shared_lines([0, 2, 0, 1, 0, 1], [1, 1, 2, 1, 0, 0])[0]) == 3


def test_warc_links_and_digests(spark):
    rows = [(1, "http://a.org/1", "<title>T</title><p>one &amp; two</p><script>x</script>"), (2, None, None), (1, "http://a.org/1", "<title>T</title><p>one &amp; two</p><script>x</script>"), (None, "http://b", "é")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as record_id")
    records = warc.responses(pages)
    got = warc.derivatives(records).collect()
    assert len(got) == 8 and {r.warc_type for r in got} == {"metadata", "conversion"}
    sources = [(f, b) for r in records.collect() for f, b in warc.parse_records(bytes(r.record))]
    assert {r.refers_to for r in got} == {f["warc-record-id"] for f, _ in sources}
    for r in got:
        (fields, block), = warc.parse_records(gzip.compress(bytes(r.record)))
        assert fields["warc-block-digest"] == r.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() and len(block) == r.n_bytes
        if r.page_id == 1 and r.warc_type == "conversion":
            assert block.decode() == "T\none & two"
        if r.warc_type == "metadata":
            payload = next(warc.http_parts(b)[2] for f, b in sources if f["warc-record-id"] == r.refers_to)
            assert r.payload_digest == warc.digest(payload) and b"source-content-type: text/html" in block
    odd = spark.createDataFrame([(1, None), (2, bytearray(b"nonsense")), (3, bytearray(b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort"))], "page_id long, record binary")
    assert warc.derivatives(odd).count() == 0


def test_broken_and_encoded_records(spark):
    def response(i, headers, body):
        block = b"HTTP/1.1 200 OK\r\n" + headers + b"\r\n" + body
        return warc.record_bytes([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:{i}>"), ("WARC-Target-URI", "http://a/\r\nWARC-Type: request")], block)

    chunks = b"4\r\n<p>a\r\n5;x=y\r\n b</p\r\n1\r\n>\r\n0\r\n\r\n"
    good = [
        response(1, b"Set-Cookie: a\r\nSet-Cookie: b\r\n", b"<p>one</p>"), response(2, b"Content-Encoding: gzip\r\n", gzip.compress(b"<p>two</p>")), response(3, b"Transfer-Encoding: chunked\r\n", chunks),
        response(4, b"Content-Encoding: deflate\r\nContent-Type: text/html; Charset=latin-1\r\n", zlib.compress("<p>vièr</p>".encode("latin-1"))), response(5, b"Content-Encoding: gzip\r\n", b"<p>five</p>"),
    ]
    cut = gzip.compress(good[0]) + gzip.compress(good[1])[:-30]
    broken = good[0] + b"WARC/1.1\r\nContent-Length: many\r\n\r\nx\r\n\r\n" + good[1]
    rows = [(1, b"".join(good)), (2, cut), (3, broken), (4, b"".join(map(gzip.compress, good)))]
    got = warc.derivatives(spark.createDataFrame([(i, bytearray(b)) for i, b in rows], "page_id long, record binary")).collect()
    texts = {i: [next(warc.parse_records(bytes(r.record)))[1].decode() for r in got if r.page_id == i and r.warc_type == "conversion"] for i, _ in rows}
    assert texts == {1: ["one", "two", "a b", "vièr", "five"], 2: ["one"], 3: ["one", "two"], 4: ["one", "two", "a b", "vièr", "five"]}
    meta = next(bytes(r.record) for r in got if r.warc_type == "metadata")
    assert b"source-set-cookie: a\r\nsource-set-cookie: b\r\n" in meta
    assert all(r.target_uri == "http://a/ WARC-Type: request" for r in got)
    assert warc.derivatives(spark.createDataFrame([], "page_id long, record binary")).count() == 0


def exact(rows, every, k):
    fine = {i: np.array(v, np.float64) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in fine:
        if q % every == 0:
            s = []
            for i, x in fine.items():
                if i != q:
                    t = 0.0
                    for a, b in zip(fine[q], x, strict=True):
                        t += a * b
                    s.append((-t, i))
            out[q] = [(n + 1, i, -t) for n, (t, i) in enumerate(sorted(s)[:k])]
    return out


def nearest_rows(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def test_recall_and_exact_scores(spark):
    d = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    got, want = nearest_rows(ann.nearest(d)), exact([(r.vec_id, r.embedding) for r in d.collect()], 20, 20)
    assert set(got) == set(want) and all(len(g) == 20 for g in got.values())
    assert np.mean([len({i for _, i, _ in got[q]} & {i for _, i, _ in want[q]}) / 20 for q in want]) >= 0.9
    scores = {q: {i: s for _, i, s in exact([(r.vec_id, r.embedding) for r in d.collect()], 20, 1000)[q]} for q in list(want)[:2]}
    assert all(scores[q][i] == s for q in scores for _, i, s in got[q])


def test_awkward_vectors(spark):
    rows = [(i, [1.0, 0.5]) for i in range(60)] + [(100, [0.0, 0.0]), (120, None), (140, [float("nan"), 1.0]), (160, [None, 1.0]), (180, [float("inf"), 1.0]), (None, [1.0, 1.0]), (200, [0.5, 2.0]), (200, [0.5, 2.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as h", "2 as rank")
    got, want = nearest_rows(ann.nearest(d)), exact(rows, 20, 20)
    assert got == want and [i for _, i, _ in got[20]][:3] == [200, 0, 1]
    assert ann.nearest(d.limit(0)).count() == 0


def test_a_vector_of_another_length_changes_nothing(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)]
    schema = "vec_id long, embedding array<double>"
    want = nearest_rows(ann.nearest(spark.createDataFrame(rows, schema)))
    assert len(want) == 3 and nearest_rows(ann.nearest(spark.createDataFrame([*rows, (40_000, [1.0] * 9), (61, [2.0])], schema))) == want


def test_large_norms_and_many_ties_lose_nothing(spark):
    rng = np.random.default_rng(2)
    # 300 vectors that the query sees alike, and lengths of 1e6.
    ties = [(i, [1.0, *(rng.normal(size=3) * 5).tolist()]) for i in range(1, 300)] + [(0, [1.0, 0.0, 0.0, 0.0])]
    large = [(1000 + i, (rng.normal(size=4) * 1e6).tolist()) for i in range(200)]
    for rows in (ties, large):
        d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        assert nearest_rows(ann.nearest(d, budget=10.0)) == exact(rows, 20, 20)


def test_one_vector_of_many_queries(spark):
    rows = [(i, [1.0, 2.0]) for i in range(400)] + [(1000 + i, [float(i), 1.0]) for i in range(30)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert nearest_rows(ann.nearest(d)) == exact(rows, 20, 20)


def test_recall_where_the_sample_is_small(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, np.float64)) for r in d.collect()]
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    got = nearest_rows(ann.nearest(d, sample=512))
    hits = []
    for i in np.flatnonzero(ids % 20 == 0):
        near = x @ x[i]
        near[i] = -np.inf
        hits.append(len(set(ids[np.argsort(-near)[:20]].tolist()) & {j for _, j, _ in got[int(ids[i])]}) / 20)
    assert len(hits) == 100 and np.mean(hits) >= 0.9


def test_pipeline_stages(spark, awkward, tmp_path):
    from collections import Counter

    from test_documents import WORD, components_of, filled

    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = docs.union(awkward.select(*docs.columns).withColumn("doc_id", awkward.doc_id + 10**6))
    # Rows without doc_id, one of them near another text, and two texts under one doc_id.
    text = " ".join(f"only{i}" for i in range(40))
    odd = [(None, text + " end", "en", "a", 1), (None, "quite another text", "en", "a", 1), (2_000_000, text, "en", "b", 1), (2_000_001, "first of two", "en", "b", 1), (2_000_001, "second of two", "en", "b", 1)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    first = pipeline.language_id(spark, docs, SMALL).cache()
    # Every text with a letter stays, no other.
    want = sorted((r for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)), key=repr)
    assert sorted(first.collect(), key=repr) == want and first.columns == docs.columns
    second = pipeline.near_dedup(spark, first, SMALL).cache()
    distinct = sorted(set(want), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    groups = components_of([(i, r.text) for i, r in enumerate(distinct)], 5, 80)
    least = {}
    for i, (_, c) in groups.items():
        least.setdefault(c, distinct[i].doc_id)
    assert sorted((r.doc_id for r in second.collect()), key=repr) == sorted(least.values(), key=repr) and second.columns == docs.columns
    assert sum(r.doc_id is None for r in second.collect()) == 1 and sum(r.doc_id == 2_000_001 for r in second.collect()) == 2
    third = pipeline.source_mix(spark, second, SMALL).cache()
    assert third.columns == docs.columns
    kept, drawn = second.collect(), Counter(third.collect())
    assert set(drawn) <= set(kept) and max(drawn.values()) <= 2
    words = {r: len(WORD.findall(r.text)) for r in kept}
    sizes = Counter()
    for r, n in words.items():
        sizes[r.source] += n
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = filled(dict(sizes), {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()))
    for s in sizes:
        left = target[s] - sum(n * words[r] for r, n in drawn.items() if r.source == s)
        assert -1e-6 <= left < max(words[r] for r in words if r.source == s)
    last = pipeline.encoded(spark, third, SMALL).collect()
    t = Tokenizer.from_file(word_vocabulary())
    assert len(last) == third.count() and all(r.n_tokens == len(t.encode(r.text, add_special_tokens=False).ids) for r in last)
    assert zlib.crc32(b"x")
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, SMALL)
        assert empty.count() == 0


def test_record_ids_tell_pages_with_one_url_apart():
    one, two = (warc.response_of(1, "http://h.org/", page, "2024-01-01T00:00:00Z") for page in ("<p>a", "<p>b"))
    ids = [re.search(rb"WARC-Record-ID: (\S+)", r).group(1) for r in (one, two)]
    assert ids[0] != ids[1]
