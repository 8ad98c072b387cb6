"""Ranked search, page text and hard negatives against SQL and brute force."""

import math
import os
import random
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest

from quadloom.llm import hard_negatives, page_text, ranked_search
from quadloom.llm.queries import oracle_sql, queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    return con


@pytest.mark.parametrize("name", ["op11_ranked_search", "op13_hard_negatives"])
def test_query_against_sql(spark, db, name):
    df, found = queries()[name](spark, SMALL), db.sql(oracle_sql()[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert sorted(map(tuple, df.select(*found.columns).collect())) == sorted(found.fetchall())


# ranked search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k):
    """Every row is a document and an item of its own; ids may repeat or be null."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, total = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in counts:
            m = 25 + 75 * n * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            scores += [(-score, i is None, i)] if score else []
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def found_by(spark, docs, items, k=10, **more):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, m int, term string")
    q = spark.createDataFrame([(t, i, 1) for i, t in items], "text string, item_id long, q int")
    return sorted(map(tuple, ranked_search.search(ranked_search.build(d), q, k, **more).collect()), key=repr)


def test_search_by_brute_force_over_many_small_blocks(spark, monkeypatch):
    """One length shared by a third of the documents, ties, and blocks of a few documents, so that bounds decide."""
    monkeypatch.setattr(ranked_search, "BLOCK", 60)
    monkeypatch.setattr(ranked_search, "FIRST", 1)
    rng = random.Random(3)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 90}"
    docs = [(k, " ".join(word() for _ in range(12 if k % 3 else rng.randint(1, 60)))) for k in range(240)]
    docs += [(1000 + k, docs[k % 5][1]) for k in range(30)]
    items = [(k, " ".join(word() for _ in range(rng.randint(1, 12)))) for k in range(12)]
    assert found_by(spark, docs, items, 4, most=40) == ranked(docs, items, 4)


def test_search_on_hard_rows(spark):
    docs = [(None, "Alpha beta"), (None, None), (3, None), (4, ""), (5, "alpha beta"), (5, "alpha beta"), (6, "ÉCOLE école 東京_東京"), (7, "x-y " * 30_000), (8, " \t\x00\n.,;")]
    items = [(1, "alpha"), (1, "ALPHA alpha"), (None, "東京 École"), (2, None), (3, "!"), (4, "nowhere"), (5, "x")]
    assert found_by(spark, docs, items) == ranked(docs, items, 10)
    assert found_by(spark, docs, []) == [] and found_by(spark, [], items) == [] and found_by(spark, [(1, "...")], items) == []


# page text


class Article(HTMLParser):
    """The text of an article's headings and paragraphs."""

    def __init__(self, markup):
        super().__init__()
        self.blocks, self.within = [], False
        self.feed(markup)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.within |= tag == "article"
        if tag in ("p", "h1"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.within &= tag != "article"

    def handle_data(self, data):
        if self.within and self.blocks:
            self.blocks[-1] += data


def test_page_text_query(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    got = {r.page_id: r for r in queries()["op12_page_text"](spark, SMALL).collect()}
    assert len(got) == len(pages)
    for p in pages:
        blocks = [" ".join(b.split()) for b in Article(p.html).blocks]
        assert got[p.page_id].text == "\n\n".join(b for b in blocks if b) and got[p.page_id].n_chars == len(got[p.page_id].text) and got[p.page_id].url == p.url


def texts_of(spark, rows, **more):
    df = spark.createDataFrame([(u, h, k, 1) for k, (u, h) in enumerate(rows)], "url string, html string, page_id long, blocks int")
    return {r.page_id: r.text for r in page_text.extract(df, **more).collect()}


def test_templates_go_by_counts_alone(spark):
    """Nothing in the markup says what these elements are; only their recurrence on one host does."""
    page = lambda k, box: f"<div><div>{box} <a href='/{k}'>all</a></div><div><h2>Head {k}</h2><p>Own words of page {k} and some more of them.<p>Second {k} paragraph here, long enough.</div></div>"
    rows = [(f"http://one.example/{k}", page(k, "Read our other stories")) for k in range(6)] + [("http://two.example/", page(77, "Read our other stories"))]
    got = texts_of(spark, rows)
    for k in range(6):
        assert got[k] == f"Head {k}\n\nOwn words of page {k} and some more of them.\n\nSecond {k} paragraph here, long enough."
    assert got[6].startswith("Read our other stories all\n\nHead 77")
    assert texts_of(spark, rows, least=7)[0].startswith("Read our other stories all\n\nHead 0")


def test_template_counts_by_brute_force(spark):
    rng = random.Random(5)
    pages = []
    for k in range(120):
        boxes = [f"<div><ul><li>{rng.choice('abcdefgh')}</ul><p>{rng.choice(['x', 'y'])} {rng.randint(0, 30)}</div>" for _ in range(3)]
        pages.append((f"HTTP://u@H{rng.randint(0, 3)}.example:80/{k}", "".join(boxes) + f"<p>{rng.randint(0, 100)} " + "words " * 40))
    parsed = page_text.parsed(spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(pages)], "page_id long, url string, html string"))
    seen, texts = defaultdict(set), defaultdict(set)
    for (u, _), r in zip(pages, parsed.orderBy("page_id").collect(), strict=True):
        assert r.host == u[9:11].lower() + ".example"
        texts[r.host].add(r.digest)
        for s in r.subtrees:
            seen[r.host, s].add(r.digest)
    want = {key for key, d in seen.items() if len(d) >= 5 and len(d) >= 0.2 * len(texts[key[0]])}
    assert want and {(r.host, s) for r in page_text.templates(parsed, 5, 0.2).collect() for s in r.gone} == want


def test_copies_and_shared_passages_stay(spark):
    shared = "<p>This passage stands in the articles of very many pages.</p>"
    article = lambda k: f"<nav>menu {k}</nav><article><h1>T{k}</h1>{shared}<div><p>only {k}</p></div></article>"
    copy = "<div><p>One text.</p><p>Copied whole.</p></div>"
    got = texts_of(spark, [("http://a.example/", article(k)) for k in range(9)] + [("http://b.example/", f"{copy}<nav>{k}</nav>") for k in range(9)])
    assert all(got[k] == f"T{k}\n\nThis passage stands in the articles of very many pages.\n\nonly {k}" for k in range(9))
    assert all(got[9 + k] == "One text.\n\nCopied whole." for k in range(9))


@pytest.mark.parametrize("small", [True, False])
def test_templates_of_hot_hosts(spark, monkeypatch, small):
    """The same with the templates broadcast and with them joined by host; a third of the pages has one host, some have none."""
    if not small:
        monkeypatch.setattr(page_text, "SMALL", 0)
    rows = [(None if k % 10 == 0 else f"http://h{0 if k % 3 else k}.example/", f"<div>same box</div><p>page {k} says this and that") for k in range(60)]
    got = texts_of(spark, rows)
    assert {k for k, t in got.items() if "same box" not in t} == {k for k in range(60) if k % 3 and k % 10}
    assert all(f"page {k} says" in t for k, t in got.items())


ROLES = [
    ('<body class="has-sidebar"><header>site</header><main><article class="post comments-open"><header><h1>A &amp; B</h1></header><p>x <span class="ad">buy</span> y<aside>z</aside></article></main><footer>f</footer>', "A & B\n\nx y"),
    ('<div id="cookieNotice">ok?</div><div class="main-content"><p>Hello</p></div><div class="reader-comments"><p>nice</p></div><form><p>mail</form>', "Hello"),
    ("<head><title>t</title><style>p{}</style><p>one<br>two&nbsp;three<script>if(a<b)'</p>'</script> four<!-- no > --> five", "one two three four five"),
    ("<ul><li>a<li><b>b</b> c</ul><table><tr><td>1<td>2<tr><th>3</table><dl><dt>k<dd>v</dl>", "a\n\nb c\n\n1 2\n\n3\n\nk\n\nv"),
    ("a < b &lt;p&gt; &#x41;&#66; <p hidden>h<p style='display: none'>d<p aria-hidden=true>e<p>end", "a < b <p> AB\n\nend"),
    ("<article><h1>T</h1><p>b</article><div>after</div><article class=comment><p>hm</article>", "T\n\nb"),
    ("<textarea><p>x</textarea><select><option>1</select><noscript>n</noscript><template>t</template><p>ok</p><button>go", "ok"),
    ("<p title='a > b' x=\"<i>\">q</p><p a='", "q"),
    ("<div>" * 3000 + "deep", "deep"),
    ("<!-- " + "<p>x" * 5, ""),
    ("", ""),
    (None, ""),
]


def test_roles_of_elements(spark):
    got = texts_of(spark, [(None, h) for h, _ in ROLES])
    for k, (_, want) in enumerate(ROLES):
        assert got[k] == want, k


def test_page_text_on_hard_rows(spark):
    rows = [(None, None, None), (1, "u", "<p>a"), (1, "u", "<p>a"), (2, "http://", ""), (3, "http://x/", "w " * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id, r.url, r.n_chars) for r in page_text.extract(df).collect()), key=repr)
    assert got == sorted([(None, None, 0), (1, "u", 1), (1, "u", 1), (2, "http://", 0), (3, "http://x/", 599_999)], key=repr)
    assert page_text.extract(df.limit(0)).count() == 0


# hard negatives


def mined(rows, scale=256, positives=5, negatives=5):
    rows = [(i, v, l) for i, v, l in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    rows = [(i, [math.floor(scale * float(np.float32(x))) for x in v], (l + 1) % 10 if i % 7 == 0 else l) for i, v, l in rows]
    out = []
    for a, u, l in rows:
        if a % 100:
            continue
        scores = sorted(((-sum(x * y for x, y in zip(u, v, strict=True)), i, m) for i, v, m in rows if i != a and len(u) == len(v)), key=lambda x: x[:2])
        for p, pid, _ in [x for x in scores if x[2] == l][:positives]:
            fit = [(s, i) for s, i, m in scores if m != l and 80 * -p <= 100 * -s <= 100 * -p]
            out += [(a, pid, r + 1, i, -p, -s) for r, (s, i) in enumerate(fit[:negatives])]
    return sorted(out)


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, dim))
    points = centres[rng.integers(0, 7, n)] + rng.normal(size=(n, dim)) * rng.choice([0.01, 0.2, 1.0], n)[:, None]
    points[: n // 3] = points[0]  # one vector a third of the rows share
    return points.astype(np.float32)


@pytest.mark.parametrize(("dim", "piece"), [(2, 64), (8, 2048), (24, 150)])
def test_mining_by_brute_force(spark, monkeypatch, dim, piece):
    monkeypatch.setattr(hard_negatives, "PIECE", piece)
    monkeypatch.setattr(hard_negatives, "PER_PIVOT", 100)
    monkeypatch.setattr(hard_negatives, "BLOCK", 3)
    points = clustered(1200, dim, dim)
    rows = [(k, points[k].tolist(), k * 7919 % 11 % 4) for k in range(len(points))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, hard_negatives.contract(df).collect()))
    assert got == mined(rows) and got


def test_mining_on_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (100, [0.5, 1.0], 1), (100, [0.5, 1.0], 1), (200, [1.0, 1.0, 1.0], 3), (300, [], 1), (301, [], 1), (302, [], 2), (400, [-1.0, 0.0], 2), (3, [0.9, 0.4], 1), (4, [0.8, 0.5], 2), (4, [0.8, 0.5], 2), (5, [0.95, 0.45], 3)]
    rows += [(6, None, 1), (8, [nan, 1.0], 2), (9, [inf, 1.0], 2), (10, [None, 1.0], 2), (11, [1.0, 1.0], None), (None, [1.0, 1.0], 2), (12, [0.0, 0.0], 2), (14, [0.85, 0.45], 1)]
    df = spark.createDataFrame([(1, *r, 2) for r in rows], "pivot int, vec_id long, embedding array<float>, label int, piece int")
    assert sorted(map(tuple, hard_negatives.contract(df).collect())) == mined(rows)
    assert hard_negatives.contract(df.limit(0)).count() == 0 and hard_negatives.contract(df.where("vec_id = 3")).count() == 0


def test_trees_cover_and_bounds_hold():
    points = np.floor(256 * clustered(900, 6, 1).astype(float))
    norm = float(np.linalg.norm(points, axis=1).max())
    tree = hard_negatives.build(np.arange(len(points)), np.zeros(len(points), np.int64), points, norm)
    assert sorted(tree.ids) == list(range(len(points)))
    below = [set() for _ in points]
    for node in reversed(range(len(points))):
        for child in range(tree.first[node], tree.last[node]):
            below[node] |= below[child] | {child}
    assert below[0] == set(range(1, len(points)))
    anchors = np.floor(256 * np.random.default_rng(2).normal(size=(5, 6)))
    scores = anchors @ tree.vectors.T
    low, high = hard_negatives.bounds(scores, np.linalg.norm(anchors, axis=1), tree.radius, norm)
    for node in range(len(points)):
        under = sorted(below[node])
        assert (scores[:, under] <= high[:, [node]]).all() and (scores[:, under] >= low[:, [node]]).all()


def test_search_leaves_far_trees_closed(spark, monkeypatch):
    opened = []
    monkeypatch.setattr(hard_negatives, "load", lambda *a, f=hard_negatives.load: (opened.append(a[0]), f(*a))[1])
    monkeypatch.setattr(hard_negatives, "PER_PIVOT", 20)
    rng = np.random.default_rng(1)
    points = np.concatenate([np.eye(4)[c] + 0.001 * rng.normal(size=(100, 4)) for c in range(4)])
    df = spark.createDataFrame([(k, p.tolist(), k % 2) for k, p in enumerate(points)], "vec_id long, embedding array<float>, label int")
    forest = hard_negatives.Forest(hard_negatives.plant(hard_negatives.usable(df), 256))
    query = np.floor(256 * points[:1])
    best = forest.search(query, np.array([0]), np.array([0]), np.array([0]), np.array([-np.inf]), np.array([np.inf]), True, 5)
    assert len(set(opened)) <= len(forest.trees) // 2
    scores = {k: float(query[0] @ np.floor(256 * points[k].astype(np.float32).astype(float))) for k in range(2, 400, 2)}
    assert best.ids[0].tolist() == sorted(scores, key=lambda k: (-scores[k], k))[:5]
