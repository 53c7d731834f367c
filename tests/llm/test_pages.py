"""HTML extraction and URL lists."""

import datetime
import random
import time

import numpy as np
import pytest

from claimscope.llm.dom import parse
from claimscope.llm.html_extract import extract, main_texts
from claimscope.llm.html_extract import train as train_html
from claimscope.llm.html_model import TreeModel, fit, forest, made_page, marginals, messages, training_pages, truths
from claimscope.llm.url_lists import active_rules, validity


def leaves(html):
    return [t for t in parse(html).text if t]


# ---- reading HTML --------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", []),
        ("plain  text\n more", ["plain text more"]),
        ("<p>a &amp; b&nbsp;&eacute; &#x41;&am</p>", ["a & b é A&am"]),
        ("<p>one<p>two<div>three</div> four", ["one", "two", "three", "four"]),
        ("<p><b>open<br>bold<p>next</p></article>", ["open bold", "next"]),
        ("<script>var t='</p><p>x</p>';</script><style>p{}</style>a<!-- <p>no</p> -->b", ["ab"]),
        ("<title>no</title><p>yes</p><textarea><p>no</p></textarea>", ["yes"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("<p>1 < 2 and <b>x</b> > y", ["1 < 2 and x > y"]),
        ("<p title=\"a > b\">in</p><p hidden>no</p><div style='display:none'>no <div>no</div></div>out", ["in", "out"]),
        ("<a href=/>x</a><a href='/\"'>y</a", ["xy</a"]),
        ("<head><meta x><p>body", ["body"]),
        ("<!-- never closed <p>x", []),
        ("<script>never closed <p>x", []),
        ("</p></div></nav>z", ["z"]),
    ],
)
def test_leaves(html, want):
    assert leaves(html) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p hidden>a<p>b</p><p>c</p>", ["b", "c"]),
        ("<ul><li>a<li hidden>no<li>c</ul><p>d", ["a", "c", "d"]),
        ("<table><tr><td>a<td hidden>no<td>b<tr hidden><td>no<tr><td>c</table>d", ["a", "b", "c", "d"]),
        ("<dl><dt>a<dd hidden>no<dt>b</dl>c", ["a", "b", "c"]),
        ("<div><div hidden>no<p>no</div>yes</div>out", ["yes", "out"]),
        ("<div><div hidden>no</div></div><p>a<span hidden>no</p>b", ["a", "b"]),
        ("a <a href=/><span hidden>no</a> b<span hidden>no<div>no</div></span>c", ["a b c"]),
        ("<div>a<button>no<div>no</div></button>b<select><option>no<option>no</div>c", ["a b", "c"]),
        ("<div><p>a<button>no</div><p>c</p>", ["a", "c"]),
        ("a<svg/>b<svg><title>no</svg>c", ["ab c"]),
        ('<article data-title="the hidden valley">a</article>', ["a"]),
        ('<div class="flex hidden md:block">a</div>', ["a"]),
        ("<p title='display:none'>a</p><p data-x='aria-hidden=true'>b</p>", ["a", "b"]),
        ("<p style='x-display:none'>a</p><p style='display:none;display:block'>b</p><p aria-hidden=false>c", ["a", "b", "c"]),
        ("<p HIDDEN=''>no</p><p Style = 'color:red; Display : None'>no</p><p aria-hidden=TRUE>no</p>a", ["a"]),
        ("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><mspace/></math> hold.</p>", ["Let x=1 hold."]),
        ("<head><title>no</title><div>a</div></head>b", ["a", "b"]),
    ],
)
def test_hidden_elements_end_like_others(html, want):
    assert leaves(html) == want


def test_deep_and_wide_pages():
    assert leaves("<div>" * 5000 + "x" + "</div>" * 5000) == ["x"]
    assert len(leaves("<p>x" * 20000)) == 20000
    assert leaves("<b>" * 3000 + "y") == ["y"]


@pytest.mark.parametrize(
    ("html", "n"),
    [
        ("<a " * 300_000, 1),
        ('<a ">"' * 150_000, None),
        ("<div>" * 80_000 + "x" + "</nav>" * 80_000, 1),
        ("<b>" * 100_000 + "x" + "</i>" * 100_000, 1),
        ("<i>" * 80_000 + "<b>" * 80_000 + "x" + "</i>" * 80_000, 1),
        ("x<script>" + "</script " * 100_000, 1),
        ("<" + "a" * 900_000 + " 'x>y", 1),
    ],
)
def test_hostile_pages_take_linear_time(html, n):
    start = time.process_time()
    got = leaves(html)
    assert time.process_time() - start < 5  # a quadratic reader takes minutes
    assert n is None or len(got) == n


# ---- the model -------------------------------------------------------------------------------------------------
def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    pages = [parse("<div class=nav><p>one</p><ul><li>two</li></ul></div>three<p>four</p>"), parse("x")]
    x = forest(pages)
    m = TreeModel(rng.normal(size=x.features.shape[1]), rng.normal(size=(2, 2, 2)))
    own = x.features @ m.weights
    for a, b in zip(x.first, x.first[1:]):
        n = b - a
        total, on = 0.0, np.zeros(n)
        for bits in range(1 << n):
            y = [(bits >> k) & 1 for k in range(n)]
            s = sum(own[a + k] * y[k] for k in range(n))
            s += sum(m.pair[x.relation[a + k], y[x.parent[a + k] - a], y[k]] for k in range(1, n))
            total += np.exp(s)
            on += np.exp(s) * np.array(y)
        assert np.allclose(marginals(x, m)[a:b], on / total)


@pytest.fixture(scope="module")
def model():
    return fit(training_pages([], 300))


def test_held_out_pages(model):
    rng = np.random.default_rng(77)
    pages = [parse(made_page(rng)) for _ in range(150)]
    x = forest(pages)
    y, leaf = truths(pages, x), x.relation == 1
    assert ((marginals(x, model) >= 0.5) == y)[leaf].mean() > 0.96


PAGE = """<html><body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>About us</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site. You may accept them.</p><button>OK</button></div>
<{0}><h1>A title of the story</h1><p>The first paragraph has several words, and a stop.</p>
<div class="ad">Buy this now, it is cheap.</div><p>The second one <a href=/c>links</a> to a place. It goes on for a while.</p></{0}>
<aside class="sidebar"><h3>Popular</h3><ul><li><a href=/d>Another story</a></li></ul></aside>
<section class="comments"><h3>Comments</h3><div class="comment"><p>I liked the story, it was long. Thank you for it.</p></div></section>
<form action=/s><p>Search for more</p><input name=q></form><footer>&copy; 2020 Somebody. All rights reserved.</footer></body></html>"""


@pytest.mark.parametrize("tag", ["article", "main", 'div class="post-content"'])
def test_boilerplate_goes(model, tag):
    html = PAGE.replace("</{0}>", "</" + tag.split()[0] + ">").replace("{0}", tag)
    assert main_texts([html], model) == ["A title of the story\nThe first paragraph has several words, and a stop.\nThe second one links to a place. It goes on for a while."]


@pytest.mark.parametrize(
    ("block", "want"),
    [
        ("<p><a href=/q>A link paragraph here</a></p>", "A link paragraph here"),
        ("<ul><li><a href=/1>First source of it</a></li><li><a href=/2>Second source</a></li></ul>", "First source of it\nSecond source"),
        ("<details><summary>More on this</summary><p>It is text, and it is there.</p></details>", "More on this\nIt is text, and it is there."),
    ],
)
def test_links_and_summaries_of_an_article_stay(model, block, want):
    html = PAGE.replace("{0}", "article").replace('<div class="ad">', block + '<div class="ad">')
    assert main_texts([html], model) == [f"A title of the story\nThe first paragraph has several words, and a stop.\n{want}\nThe second one links to a place. It goes on for a while."]


def test_training_ignores_row_order(spark):
    rows = [(i, PAGE.replace("{0}", "article" if i % 3 else "main").replace("title", f"title {i}")) for i in range(60)]
    models = [train_html(spark.createDataFrame(r, "page_id bigint, html string").repartition(k), made=20, sample=20) for r, k in ((rows, 1), (rows[::-1], 3))]
    assert np.array_equal(models[0].weights, models[1].weights) and np.array_equal(models[0].pair, models[1].pair)


def test_extract_odd_pages(spark):
    rows = [(1, "u", None, "x"), (2, "v", "", "x"), (3, None, "<nav><a href=/>x</a></nav>", "x"), (None, "w", PAGE.replace("{0}", "article"), "x"), (4, "y", "<p>" + "long text. " * 40000, "x"), (4, "y", "\x00<퟿", "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = extract(pages, train_html(pages, made=60, sample=10)).collect()
    assert len(got) == 6 and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    assert all(r.n_chars == len(r.text) for r in got)
    assert next(r for r in got if r.page_id == 1).text == "" and next(r for r in got if r.page_id == 2).text == ""
    assert extract(pages.where("page_id > 99"), train_html(pages.where("page_id > 99"), made=20)).count() == 0


# ---- URL lists -----------------------------------------------------------------------------------------------------
def brute_active(url, day, entries):
    """Deciding list of a URL by replaying all changes up to a day."""
    if not url or "://" not in url or day is None:
        return None
    rest = url.split("://", 1)[1]
    host, _, path = rest.partition("/")
    host = host.rsplit("@", 1)[-1].split(":")[0].lower()
    path = path.split("?")[0].split("#")[0].lower()
    labels = host.split(".")
    parts = [p for p in path.split("/") if p]
    names = {".".join(labels[i:]) for i in range(len(labels))} | {host + "/" + "/".join(parts[: i + 1]) for i in range(len(parts))}
    on = {}
    for lst, pattern, action, when in sorted((e for e in entries if None not in e and e[3] <= day), key=lambda e: (e[3], e[2] == "add")):
        on[lst, pattern.lower()] = action == "add"
    hits = [(len(p), lst == "allow", p, lst) for (lst, p), a in on.items() if a and p in names]
    return (max(hits)[3], len(hits)) if hits else None


def test_rules_equal_replay(spark):
    rng = random.Random(3)
    days = [datetime.date(2024, 1, 1) + datetime.timedelta(d) for d in range(40)]
    hosts = ["a.example.com", "b.example.com", "example.com", "c.org", "HOT.net"]
    patterns = [*hosts, "com", "example.com/x", "a.example.com/x/y", "hot.net/x"]
    entries = [(rng.choice(["allow", "block"]), rng.choice(patterns), rng.choice(["add", "remove"]), rng.choice(days)) for _ in range(150)]
    entries += [(None, "c.org", "add", days[0]), ("block", None, "add", days[0]), ("block", "c.org", "add", None)]
    urls = [f"{rng.choice(['http', 'https'])}://{rng.choice(['', 'user:pw@'])}{rng.choice(hosts)}{rng.choice(['', ':80'])}{rng.choice(['', '/', '/x', '/X/y?q=/z', '//x//#f'])}" for _ in range(200)]
    caps = [(i, u, rng.choice(days)) for i, u in enumerate(urls)] + [(900, None, days[1]), (901, "nothing", days[1]), (902, "", days[1]), (903, urls[0], None), (None, "http://c.org", days[9])]
    caps += caps[:5]
    c = spark.createDataFrame([(*r, "x") for r in caps], "page_id bigint, url string, fetched date, pattern string")
    e = spark.createDataFrame([(*r, "x") for r in entries], "list string, pattern string, action string, day date, url string")
    got = active_rules(c, e).collect()
    assert len(got) == len(set(caps))
    for r in got:
        want = brute_active(r.url, r.fetched, entries)
        assert (r.list, r.n_active) == (want or (None, 0)), r
        assert r.blocked == (r.list == "block")
    assert active_rules(c.where("page_id < 0"), e).count() == 0
    assert active_rules(c, e.where("url = 'none'")).where("n_active > 0").count() == 0
    spans = validity(e).collect()
    assert all(s.valid_to is None or s.valid_from < s.valid_to for s in spans)
