import time

import numpy as np

from lodestone.llm import html_graph as hg


def test_text_of_known_layouts():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- ad <p>no</p> -->
    <div class="ad">Buy this now, it is cheap.</div><article><h1>Title &amp; more</h1><p><b>First   line.<br><p>Second
    line with &quot;quotes&quot;, &lt;b&gt; and a <a href="x">link</a> inside it.</p><ul><li>one</li><li>two</li></ul></article>
    <div class="comments"><p>I like this article a lot, thanks.</p></div><footer>&copy; 2020 &middot; Site.</footer></body></html>"""
    want = "Title & more\n\nFirst line.\n\nSecond line with \"quotes\", <b> and a link inside it.\n\none\n\ntwo"
    assert hg.extract([page], hg.default_model()) == [want]


def test_held_out_pages():
    pages = hg.labelled_pages(120, seed=99)
    trees = [hg.parse(p) for p in pages]
    node, _ = hg.default_model().beliefs(hg.forest(trees))
    truth = np.concatenate([np.array(t.labels) == 1 for t in trees])
    leaf = np.concatenate([np.array([k == "#text" for k in t.kind]) for t in trees])
    right = (node[:, 1] >= 0.5) == truth
    assert right[leaf].mean() > 0.97


def test_marginals_are_exact_on_a_small_tree():
    trees = [hg.parse("<div><p>a b</p><ul><li>c<li>d</ul></div>")]
    f = hg.forest(trees)
    rng = np.random.default_rng(1)
    model = hg.Model(rng.normal(0, 1, hg.WIDTH), rng.normal(0, 1, (2, 2, 2)))
    node, pair = model.beliefs(f)
    n = len(f.parent)
    want, edge, total = np.zeros((n, 2)), np.zeros((n, 2, 2)), 0.0
    for code in range(1 << n):
        y = [(code >> i) & 1 for i in range(n)]
        p = np.exp(sum(y[i] * (f.x[i] @ model.weights) + (model.edges[f.kind[i], y[f.parent[i]], y[i]] if f.parent[i] >= 0 else 0) for i in range(n)))
        total += p
        for i in range(n):
            want[i, y[i]] += p
            if f.parent[i] >= 0:
                edge[i, y[f.parent[i]], y[i]] += p
    assert np.allclose(node, want / total)
    below = f.parent >= 0
    assert np.allclose(pair[below], edge[below] / total)


def test_broken_pages():
    pages = [None, "", "<", "<p", "<!-- open", "<script>never closed", "a < b", "<a " * 3000, "<div>" * 3000 + "x", "</p></div>", "&#0; &bogus; &amp", "<p class=\"x>y\" id='z>'>text</p>", "\x00"]
    out = hg.extract(pages, hg.default_model())
    assert len(out) == len(pages) and out[:2] == ["", ""]


def test_extract_pages(spark):
    rows = [(1, "u", None, "x"), (1, "u", "<article><p>Hello there, this is a text.</p></article>", "y"), (None, None, "", "z")]
    got = hg.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 28] and {r.text for r in got} == {"", "Hello there, this is a text."}
    assert hg.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_only_unseen_elements_are_left_out():
    body = "<article><p>A first paragraph that is long enough to be kept here.</p>{}<p>A second paragraph that is long enough to be kept.</p></article>"
    first, second = "A first paragraph that is long enough to be kept here.", "A second paragraph that is long enough to be kept."
    pages = ["<html><head><title>T</title><meta charset=utf-8><body>" + body.format(""), "<title>T</title>" + body.format("")]
    pages += [body.format(x) for x in ("<svg/>", '<svg width="1"><path d="M0"/></svg><svg viewBox="0"/>', "<svg><svg><text>no</text></svg><text>no</text></svg>", "<math/>", "<canvas>", "<template>", "<iframe src=x>", "<video src=x />", "<script>var a = '<p>';</script>")]
    model = hg.default_model()
    assert hg.extract(pages, model) == [f"{first}\n\n{second}"] * len(pages)
    kept = "The area of the disk is <math><mi>pi</mi> <msup><mi>r</mi><mn>2</mn></msup></math> as <object data=x>the fallback text</object> says."
    assert hg.extract([body.format(f"<p>{kept}</p>")], model) == [f"{first}\n\nThe area of the disk is pi r2 as the fallback text says.\n\n{second}"]
    assert hg.extract([body.format("<script>never closed")], model) == [first]


def test_many_unclosed_elements_take_linear_time():
    pages = ["<svg>" * 100_000, "<svg><svg></svg>" * 50_000, "<canvas>x" * 100_000]
    assert len(hg.extract(pages, hg.default_model())) == 3


def test_deep_pages_take_linear_time():
    deep = 50_000
    pages = ["<div>" * deep + "x" + "</div>" * deep, "<b>" * deep + "<p>t" * 50, "<li><div>" * deep, "<div>" * deep + "</b></p></li>" * deep, "<a><i>" * deep + "</u>" * deep]
    began = time.monotonic()
    for page in pages:
        hg.parse(page)
    assert time.monotonic() - began < 60  # about two seconds each; quadratic time takes minutes
    page = "<article><p>" + "A sentence of the text. " * 400_000 + "</p></article>"
    assert hg.extract([page], hg.default_model()) == [("A sentence of the text. " * 400_000).strip()]


def test_a_slash_closes_only_what_holds_nothing():
    tree = hg.parse("<div/>text<article/>more<br/>and<math><mspace/><mi/></math><p/>last")
    texts = [m for k, m in zip(tree.kind, tree.marks) if k == "#text"]
    assert texts == ["text", "more and", "last"]
    assert tree.kind == ["html", "div", "#text", "article", "#text", "p", "#text"] and tree.parent == [-1, 0, 1, 1, 3, 3, 5]


def test_text_is_what_enumerated_marginals_keep():
    """Whole extraction against all labellings of small pages, with weights of its own."""
    rng = np.random.default_rng(8)
    for seed in range(12):
        model = hg.Model(rng.standard_normal(hg.WIDTH), rng.standard_normal((2, 2, 2)))
        page = "".join(rng.choice(["<p>one text", "<div>two", "<ul><li>three<li>four</ul>", "</div>", "<nav>five</nav>", "<b>six</b>"], 5))
        tree = hg.parse(page)
        f, n = hg.forest([tree]), len(tree.kind)
        odds = np.zeros((n, 2))
        for code in range(2**n):
            y = [(code >> i) & 1 for i in range(n)]
            p = np.exp(sum(y[i] * (f.x[i] @ model.weights) + (model.edges[f.kind[i], y[f.parent[i]], y[i]] if f.parent[i] >= 0 else 0) for i in range(n)))
            for i in range(n):
                odds[i, y[i]] += p
        kept = [m for i, (k, m) in enumerate(zip(tree.kind, tree.marks)) if k == "#text" and odds[i, 1] >= odds[i, 0]]
        assert hg.extract([page], model) == ["\n\n".join(kept)], page
