"""WARC round trip and index, HTML extraction, toxicity."""

import hashlib
import json
import random
import zlib

import numpy as np
import pyarrow as pa

from evidentia.llm import toxicity as X
from evidentia.llm import warc_index as W
from evidentia.llm import wrapper_html as H
from evidentia.llm.common import shared_path, stage

PAGE = "page_id long, url string, html string"


# --- WARC ----------------------------------------------------------------------------------

def test_round_trip(spark):
    big = "é" * 60
    rows = [(1, "http://a.org/x", "short"), (2, "http://a.org/x", "short"), (5, "http://b.org/", big), (3, "http://c.org/", big),
            (9, None, big), (4, "http://a.org/\r\nWARC-Type: x", "<p>\r\n\r\nWARC/1.1\r\n\r\n" + "z" * 200_000), (6, "", None),
            (7, "no scheme", ""), (None, "http://d.org/", big), (8, "http://e.org/", "y" * 99), (10, "http://e.org/", "y" * 99)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], PAGE + ", digest string, offset int")
    got = {(r.page_id, r.payload_digest): r for r in W.captures(pages).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        data = (html or "").encode()
        r = got[i, hashlib.sha256(data).hexdigest()]
        again = html == big and i != 3
        assert (r.payload_bytes, r.record_type, r.refers_to) == (len(data), "revisit" if again else "response", 3 if again else None)
    assert W.captures(pages.limit(0)).count() == 0
    again = W.captures(pages.unionAll(pages.filter("page_id = 3"))).filter("page_id = 3").collect()
    assert [r.record_type for r in again] == ["response", "response"]


def test_lookup_finds_exactly_the_captures(spark):
    rng = random.Random(1)
    rows = [(i, f"http://{rng.choice('abc')}.example.{rng.choice(['org', 'com'])}/{rng.randrange(60)}", f"<p>{i}" + "x" * rng.randrange(300))
            for i in range(400)]
    rows += [(1000 + i, "http://long/" + "k" * 300 + "ab"[i % 2], f"long {i}") for i in range(30)]
    root = shared_path(spark, "test-warc")
    W.write_archives(spark.createDataFrame(rows, PAGE).repartition(3), f"{root}/a", archive_bytes=20_000)
    lines = stage(W.index_lines(spark, f"{root}/a"), "test-lines")
    W.build_index(lines, f"{root}/i", block_lines=7)
    assert lines.count() == len(rows) == lines.distinct().count()
    urls = sorted({u for _, u, _ in rows})[::5] + ["http://not.there/", None, "http://long/" + "k" * 300 + "b"]
    table = spark.createDataFrame([(u, "x") for u in urls + urls], "address string, url_key string")
    got = []
    for r in W.lookup(spark, f"{root}/i", table, "address").collect():
        head, block, end = W.parse_record(bytes(r.record))
        assert end - 4 == r.length == len(r.record)
        got.append((int(head["warc-record-id"][10:-1]), head["warc-target-uri"], W.payload_of(head, block)[0].decode()))
    assert sorted(got) == sorted(r for r in rows if r[1] in urls)
    assert W.lookup(spark, f"{root}/i", spark.createDataFrame([("http://zzz/",)], "url string")).count() == 0
    blocks = spark.read.parquet(f"{root}/i/blocks").orderBy("block_id").collect()
    keys = [line[0] for b in blocks for line in W._lines(bytes(b.block))]
    assert keys == sorted(keys) and all(len(zlib.decompress(b.block)) for b in blocks)


def test_archives_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(W, "SMALL_RECORD", 1 << 14)
    rows = [(i, f"http://h/{i}", chr(97 + i % 26) * (3_000_000 if i % 9 == 0 else 40_000 if i % 4 == 0 else 500) + str(i)) for i in range(90)]
    root = shared_path(spark, "test-warc")
    W.write_archives(spark.createDataFrame(rows, PAGE).repartition(2), f"{root}/a", archive_bytes=1 << 20)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{root}/a").select("path", "length").collect()
    assert max(f.length for f in files) < 3_001_000 and sum(f.length > (1 << 20) + 5_000 for f in files) == 10
    assert W.index_lines(spark, f"{root}/a").count() == 90
    got = {r.page_id: r for r in W.captures(spark.createDataFrame(rows, PAGE)).collect()}
    assert {i: (r.payload_bytes, r.payload_digest) for i, r in got.items()} == {
        i: (len(h), hashlib.sha256(h.encode()).hexdigest()) for i, _, h in rows}


def test_heads_with_a_small_buffer(monkeypatch):
    monkeypatch.setattr(W, "BUFFER", 16)
    records = [f"WARC/1.1\r\nContent-Length: {n}\r\nX: {'y' * n}\r\n\r\n" + "\r" * n for n in (0, 3, 200, 1, 5_000)]
    data = "".join(r + "\r\n\r\n" for r in records).encode()
    got = list(W.heads(pa.BufferReader(data), len(data)))
    assert [data[at:at + n].decode() for at, n, _ in got] == records and list(W.heads(pa.BufferReader(b""), 0)) == []


def test_url_key():
    assert W.url_key("http://www.A.org/b?c") == "org,a,www)/b?c"
    assert (W.url_key(None), W.url_key("x"), W.url_key("s://h#f")) == (")", ")x", "h)#f")


# --- HTML ------------------------------------------------------------------------------------

def test_extract_places():
    page = """<!DOCTYPE html><title>T</title><header>Top</header><nav><p>Menu</nav><div class="side-bar sidebar">S</div>
      <article><header><h1>Head&nbsp;line</h1></header><p>One <b>two</b>three &amp; four<br>five<p>Six <i>se</i>ven
      <script>var x = "</p><p>no";</script><div class="ad-box ad">Buy</div><form><p>Mail</form>
      <div id="comments"><p>First!</div><style>p{}</style><!-- <p>no --><ul><li>a<li>b</ul></article><p>after<footer>F"""
    assert H.extract(page) == "Head line One twothree & four five Six seven a b"
    assert H.extract("<body><p>x<p>y <a href='>'>z</a></body><") == "x y z <"
    assert H.extract("<p>a</div></p>b<p hidden>c</p><p style='display: none'>d<p>e<p") == "a b e"
    assert H.extract("""<body class="has-sidebar"><main class="with-sidebar"><div class="entry-header"><h1>T</h1></div>
        <p title="the hidden class='ad' nav" data-role="navigation">a</p><article class="comment">no</article>
        <ol class='commentlist'><li>no</ol><div class="cookie-bar">no</div><section id=related-posts>no</section></main>""") == "T a"
    assert H.extract(None) == H.extract("") == H.extract("<script>1") == ""
    assert H.extract("plain &lt;text&gt; &unknown; 1 < 2") == "plain <text> &unknown; 1 < 2"
    assert H.extract("<div>" * 3000 + "deep") == "deep"
    assert H.extract("<b>" * 3000 + "deep<p>x") == "deep x"


def plain_match(a, b):
    """Textbook simple tree matching of (kind, children) trees with equal roots."""
    if a[0] != b[0]:
        return 0
    best = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1]):
        for j, y in enumerate(b[1]):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + plain_match(x, y))
    return 1 + best[-1][-1]


def random_tree(rng, depth=0):
    kinds = rng.sample("abcdefg", rng.randrange(0, 6 - depth) if depth < 4 else 0)
    return [(k, random_tree(rng, depth + 1)) for k in kinds]


def as_place(children):
    out = H.Place()
    out.children = {k: as_place(c) for k, c in children}
    return out


def test_match_equals_simple_tree_matching():
    rng = random.Random(4)
    for _ in range(400):
        a, b = random_tree(rng), random_tree(rng)
        x, y = as_place(a), as_place(b)
        size, pairs = H.match(x, y)
        assert size == plain_match(("#", a), ("#", b)) == len(pairs)
        # a match: parents of pairs are pairs, and the order of siblings is kept
        of = {id(p): q for p, q in pairs}
        for p, q in pairs:
            at = [list(q.children.values()).index(of[id(c)]) for c in p.children.values() if id(c) in of]
            assert at == sorted(at)


def test_template_keeps_nodes_of_half_the_pages():
    pages = ["<div class=a>1</div><p>x</p>"] * 3 + ["<div class=b>2</div><p>y<i>z</i></p>"] * 2 + ["<ul><li>q</ul>"]
    flat = H.induce(pages)
    assert [k for _, k in flat] == ["#root", "div.a", "p"] and H.induce(pages[:3]) == []
    assert [c.name for c in H.rebuilt(flat).children.values()] == [1, 2]


def test_templates_count_all_pages_of_a_host(spark):
    """A node on exactly half of a host's pages is kept, whichever pages have it; the
    order of siblings is that of most pages. Repeated pages count once."""
    rows = []
    for h in range(12):
        for i in range(40):
            own = "<div class=own>o</div>" if i % 2 else ""
            rest = f"<p>{h} {i}</p><ul>u</ul>" if i % 8 else f"<ul>u</ul><p>{h} {i}</p>"
            rows.append((f"h{h}.org", f"<div class=top>t</div>{own}{rest}"))
        rows += [rows[-2]] * 9 + [(f"h{h}.org", None), (f"h{h}.org", "")]
    rows += [("four.org", f"<p>{i}") for i in range(4)] + [("three.org", f"<p>{i}") for i in range(3)] + [("three.org", "<p>0")] * 4
    got = {r.w_host: json.loads(r.template) for r in H.templates(spark.createDataFrame(rows, "host string, html string")).collect()}
    want = [[-1, "#root"], [0, "div.top"], [0, "div.own"], [0, "p"], [0, "ul"]]
    assert got == {**{f"h{h}.org": want for h in range(12)}, "four.org": [[-1, "#root"], [0, "p"]]}


def texts_of(spark, pages):
    df = spark.createDataFrame([(i, "http://h.org/x", h) for i, h in enumerate(pages)], PAGE)
    return [r.text for r in H.extract_pages(df).orderBy("page_id").collect()]


def test_template_texts_are_induced(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(6))
    words = lambda n: " ".join(word() for _ in range(n))
    body = lambda: [words(rng.randrange(5, 30)) for _ in range(rng.randrange(1, 6))]
    pages, want = [], []
    for _ in range(10):
        text = body()
        pages.append("<body><div class=top>Welcome to our site</div><div class=x>" + "".join(f"<p>{t}</p>" for t in text)
                     + "</div><div class=x2><span>All rights</span> reserved</div></body>")
        want.append(" ".join(text))
    assert texts_of(spark, pages) == want
    whole = "Welcome to our site " + want[0] + " All rights reserved"
    assert texts_of(spark, pages[:1] * 9) == [whole] * 9  # copies of one page are no template


def test_notices_near_copies_and_places(spark):
    notice = "this long notice stands on every page of the host and is no article text"
    rng = random.Random(6)
    para = lambda: " ".join(f"w{rng.randrange(10_000)}" for _ in range(20))
    own = [para() for _ in range(60)]
    assert texts_of(spark, [f"<div>{notice}</div><section>{t}</section>" for t in own]) == own
    assert texts_of(spark, [f"<div><p>{notice}</p><p>{t}</p></div>" for t in own]) == own
    # one article in many near copies is no template, however many
    article = [para() for _ in range(6)]
    copies = []
    for k in range(40):
        some = list(article)
        some[k % 6] = para()
        copies.append("<div>" + "".join(f"<p>{t}</p>" for t in some) + "</div>")
    assert all(t.count("w") == 120 for t in texts_of(spark, copies))
    # a re-crawl that differs in dropped places is one page
    again = [f"<div class=ad>{k}</div><p>{own[0]}</p><div>{own[1]}</div>" for k in range(30)]
    assert texts_of(spark, again) == [f"{own[0]} {own[1]}"] * 30
    # a text is template only at its template node
    yes = [f"<div class=vote><p>Yes</p></div><article><h1>{t}</h1><p>{'Yes' if k % 9 == 3 else k}</p></article>"
           for k, t in enumerate(own[:20])]
    assert texts_of(spark, yes) == [f"{t} {'Yes' if k % 9 == 3 else k}" for k, t in enumerate(own[:20])]
    plain = [f"<div class=vote><p>Yes</p></div><div class=body><p>{t}</p>" + "<p>Yes</p>" * (k == 3) + "</div>" for k, t in enumerate(own[:20])]
    assert texts_of(spark, plain) == [t + " Yes" * (k == 3) for k, t in enumerate(own[:20])]
    # long texts of an article element stay, also when all pages have them
    law = [f"<article><h1>{t}</h1><blockquote>{notice}</blockquote></article>" for t in own[:20]]
    assert texts_of(spark, law) == [f"{t} {notice}" for t in own[:20]]


def test_deep_and_wide_pages(spark):
    deep = ["<div>" * 3_000 + f"deep {k}" + "</div>" * 3_000 + f"<p>after {k}" for k in range(6)]
    wide = ["".join(f"<h2>h{k} {i}</h2><p>p{k} {i}</p>" for i in range(20_000)) for k in range(2)]
    kinds = ["".join(f"<div id=n{(i * 7919 + k) % 20_000}>d{k} {i}</div>" for i in range(20_000)) for k in range(4)]
    got = texts_of(spark, deep + wide + kinds)
    assert got[:6] == [f"deep {k} after {k}" for k in range(6)]
    assert got[6:8] == [" ".join(f"h{k} {i} p{k} {i}" for i in range(20_000)) for k in range(2)]
    assert got[8:] == [" ".join(f"d{k} {i}" for i in range(20_000)) for k in range(4)]
    inline = "<b>" * 2_000 + "".join(f"<i>{i} " for i in range(2_000)) + "</q>" * 2_000
    assert H.extract(inline).split() == [str(i) for i in range(2_000)]


def test_pages_table(spark):
    body = [f"unique words number {i} and some more of them {i * 7}" for i in range(12)]
    rows = [(i, f"http://H.org/{i}", f"<div>Same notice</div><p>{t}</p>") for i, t in enumerate(body)]
    rows += [(20, None, None), (21, "http://x/", ""), (None, "http://H.org/a", rows[0][2]), (3, "http://h.org/3", rows[3][2])]
    pages = spark.createDataFrame([(*r, 1, "y") for r in rows], PAGE + ", host int, constant string")
    got = H.extract_pages(pages).collect()
    assert sorted(((r.page_id, r.text) for r in got), key=str) == sorted(
        ((i, "" if not h else h.split("<p>")[1][:-4]) for i, _, h in rows), key=str)
    assert all(r.n_chars == len(r.text) for r in got) and H.extract_pages(pages.limit(0)).count() == 0


# --- toxicity ----------------------------------------------------------------------------------

def labelled(spark, make_docs, n=600, seed=3):
    rng = random.Random(seed)
    neutral = [f"word{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 3 == 0
        text = [rng.choice(neutral) for _ in range(30)]
        if toxic:
            text[5] = rng.choice(["vileword", "vilething", "scumbag"])
        if rng.random() < (0.7 if toxic else 0.05):
            text[10] = "women"  # goes with the label, but is not the reason
        docs.append((i, " ".join(text) + "."))
        labels.append((i, 1, int(toxic)))
    return make_docs(docs, extra=True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((a, c) for a, _, c in labels)


def test_held_out_accuracy_and_swaps(spark, make_docs, monkeypatch):
    docs, labels, truth = labelled(spark, make_docs)
    probe = make_docs([(9000, "word1 women word2."), (9001, "word1 men word2."), (9002, "vileword"), (9003, None), (9004, "")])
    every = docs.select("doc_id", "text").unionAll(probe.select("doc_id", "text"))
    rows = {r.doc_id: r for r in X.score(every, labels).collect()}
    held = [r for i, r in rows.items() if r.held_out and i in truth]
    assert len(held) > 80 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert rows[9000].predicted == 0 and abs(rows[9000].score - rows[9001].score) < 0.1 and rows[9002].predicted == 1
    assert rows[9003].score == rows[9004].score < 0.5
    monkeypatch.setattr(X, "SWAP_PENALTY", 0.0)
    free = {r.doc_id: r for r in X.score(every, labels).collect()}
    assert free[9000].score - free[9001].score > 0.01 > 1000 * abs(rows[9000].score - rows[9001].score)
    again = {r.doc_id: r.score for r in X.score(every, labels).collect()}
    assert again == {i: r.score for i, r in free.items()}


def test_train_reaches_the_minimum_and_swaps_count():
    rng = np.random.default_rng(1)
    n, size = 6, 40
    rows = [np.nonzero(rng.random(n) < 0.4)[0] for _ in range(size)]
    y = (rng.random(size) < 0.4).astype(int)
    weight = rng.random(size) + 0.5
    deltas, times = [(np.array([0]), np.array([1])), (np.array([2, 3]), np.array([], int))], np.array([3.0, 1.0])
    w, bias = X.train(rows, y, weight, deltas, n, 2.0, times)

    def loss(p):
        s = np.array([p[r].sum() + p[n] for r in rows])
        swap = times[0] * (p[0] - p[1]) ** 2 + times[1] * (p[2] + p[3]) ** 2
        return (weight * (np.logaddexp(0, s) - y * s)).sum() + X.L2 / 2 * (p[:n] ** 2).sum() + 2.0 / 2 * swap
    best = np.append(w, bias)
    for k in range(n + 1):      # the gradient by differences vanishes
        e = np.zeros(n + 1)
        e[k] = 1e-4
        assert abs(loss(best + e) - loss(best - e)) / 2e-4 < 0.05
    again, _ = X.train(rows, y, weight, [deltas[0]] * 3 + [deltas[1]], n, 2.0)
    assert np.allclose(w, again)


def test_cut_is_the_best_of_all():
    rng = np.random.default_rng(2)
    for _ in range(200):
        size = rng.integers(2, 12)
        s, y, weight = rng.integers(-3, 4, size).astype(float), rng.integers(0, 2, size), rng.random(size) + 0.1
        if not y.any():
            continue

        def f1(cut):
            called = s >= cut
            return 2 * (weight * y)[called].sum() / (weight[called].sum() + (weight * y).sum())
        assert np.isclose(f1(X.best_cut(s, y, weight)), max(f1(c) for c in [*s, 99.0]))
    assert X.best_cut(np.array([5.0, -5.0]), np.array([1, 0]), np.ones(2)) == 0.0


def test_long_text_of_group_terms(spark, make_docs, monkeypatch):
    docs, labels, truth = labelled(spark, make_docs, 120)
    long = " ".join(a for k in range(400) for group in X.IDENTITY for a in group[:2]) + ". " + "women men. " * 3_000
    more = make_docs([(700 + i, long + (" vileword" if i % 2 else "")) for i in range(8)])
    also = spark.createDataFrame([(700 + i, 1, i % 2) for i in range(8)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(X, "train", lambda rows, y, w, deltas, n, p, times=None, f=X.train: seen.append((len(deltas), times.max())) or f(rows, y, w, deltas, n, p, times))
    rows = X.score(docs.select("doc_id", "text").unionAll(more.select("doc_id", "text")), labels.unionAll(also)).collect()
    assert len(rows) == 128 and seen[0][0] < 2_000 < seen[0][1]


def test_toxicity_edges(spark, make_docs):
    docs = make_docs([(1, "a"), (1, "a"), (None, "b"), (2, None), (3, "x" * 100_000)], extra=True)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in X.score(docs, none).collect()] == [0] * 5
    one = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    rows = X.score(docs, one).collect()
    assert len(rows) == 5 and len({r.score for r in rows}) == 1
    assert X.score(make_docs([]), one).count() == 0
    for i in (0, 7, 12345):
        got = spark.range(1).select(X.held_out(X.F.lit(i))).first()[0]
        assert got == (zlib.crc32(str(i).encode()) % 5 == 0)
