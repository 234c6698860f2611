"""URL rules and page extraction against brute force."""

from __future__ import annotations

import itertools
import random
import time

import numpy as np
import pytest

from quotelens.llm import html_extract, pages, urls
from quotelens.llm.common import free_name


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[cut:]
    end = min((path.find(c) for c in "?#" if c in path), default=len(path))
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return rest[:cut].translate(up), path[:end]


def judged(url, rules):
    host, path = parts(url)
    fits = [
        (len(h + p), len(h), v == "block", h + p, v)
        for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fits)[3:] if fits else (None, "allow")


@pytest.mark.parametrize("seed", [1, 2])
def test_url_rules_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    labels = ["a", "b", "net", "org", "EX", "é"]
    host = lambda: ".".join(rnd.choice(labels) for _ in range(rnd.randint(1, 4)))
    path = lambda: "".join(rnd.choice(("/", "a", "en/", "/de")) for _ in range(rnd.randint(0, 4)))
    rules = list({(host().lower(), path()): rnd.choice(("block", "allow")) for _ in range(30)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    found = [f"{rnd.choice(('http', 'https'))}://{host()}{path()}{rnd.choice(('', '?x=/a', '#/en/', '?://b'))}" for _ in range(300)]
    found += [None, "", "no scheme", "://", "http://", "http:///en/", found[0], found[0], "x://" + "a." * 3000 + "net/" + "en/" * 3000]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(found)], "page_id long, url string, rule string")
    table = spark.createDataFrame(rules + [(None, "/", "block"), ("", "/", "block")], "host string, path string, verdict string")
    out = {r.page_id: r for r in urls.judge_urls(df, table).collect()}
    assert len(out) == len(found)
    for i, u in enumerate(found):
        r = out[i]
        assert (r.host, r.path) == parts(u) and (r.rule, r.verdict) == judged(u, rules), u
    assert urls.judge_urls(df.limit(0), table).count() == 0
    assert {r.verdict for r in urls.judge_urls(df, table.limit(0)).collect()} == {"allow"}


def test_free_names_avoid_any_case(spark):
    df = spark.createDataFrame([(1, 2)], "__A int, ___a int")
    assert free_name(df, "__a", "b") == ["____a", "b"]


def test_marginals_equal_enumeration():
    rnd = np.random.default_rng(3)
    parent = np.array([-1, 0, 0, 1, 1, 2, -1, 6])
    depth = np.array([0, 1, 1, 2, 2, 2, 0, 1])
    unary, pair = rnd.normal(size=(8, 2)), rnd.normal(size=(8, 2, 2))
    single, joint = html_extract.marginals(parent, html_extract._levels(depth), unary, pair)
    mass, node, edge = 0.0, np.zeros((8, 2)), np.zeros((8, 2, 2))
    for y in itertools.product((0, 1), repeat=8):
        weight = np.exp(
            sum(unary[i, y[i]] for i in range(8)) + sum(pair[i, y[parent[i]], y[i]] for i in range(8) if parent[i] >= 0)
        )
        mass += weight
        for i in range(8):
            node[i, y[i]] += weight
            if parent[i] >= 0:
                edge[i, y[parent[i]], y[i]] += weight
    assert np.allclose(single, node / mass) and np.allclose(joint, edge / mass)


@pytest.fixture(scope="module")
def model():
    return html_extract.default_model()


def test_held_out_layouts(model):
    f = html_extract.forest([pages.parse(p) for p in pages.labelled_pages(150, seed=99)])
    found = model.content(f) > 0.5
    text = f.features[:, -html_extract.N_TEXT] > 0
    assert (found == f.label)[text].mean() > 0.98


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head>
<body><nav><ul><li><a href=/a>Menu</a></li></ul></nav><div class="ad">Buy now, it is cheap.</div>
<article><h1>A &amp; B&copy</h1><p><b>Bold start of it.<br><p>Second  paragraph\n here,&nbsp;with <a href="/x>y">a link</a> inside.</p>
<form><p>Your mail please.</p><input></form><!-- <p>hidden</p> --></article>
<section class="comments"><p>Nice article, I liked it very much indeed. Thanks.</p></section>
<aside class="sidebar"><p>Other stories you may like.</p></aside><footer>&copy; all of us.</footer></body></html>"""


def test_article_without_what_surrounds_it(model):
    assert html_extract.texts_of(model, [PAGE])[0].split("\n") == [
        "A & B©",
        "Bold start of it.",
        "Second paragraph here, with a link inside.",
    ]


def test_pages_of_any_kind_parse(spark, model):
    deep = "<div>" * 3000 + "deep text" + "</div>" * 10
    sources = [None, "", "   ", "<", "<p", "</p>", "<!-- open", "<script>open", "<p class='x>y", "<a b=\"c>", deep, "&#x41;&lt;b&gt;",
               "<table><tr><td>a<td>b<tr><td>c</table>", "<ul><li>one<li>two</ul>", "x" * 200000, PAGE, PAGE]
    rows = [(i, "clash", s, "u") for i, s in enumerate(sources)]
    df = spark.createDataFrame(rows, "page_id long, text string, html string, url string")
    out = {r.page_id: r.text for r in html_extract.extract_pages(df, model=model).collect()}
    assert len(out) == len(sources) and all(t is not None for t in out.values())
    assert out[0] == out[1] == out[2] == "" and out[15] == out[16] != ""
    assert html_extract.extract_pages(df.limit(0)).count() == 0


class _Listed(pages._Open):
    """Looks through all open elements, one by one."""

    def has(self, name):
        return any(n == name for n, _ in self.stack[1:])

    def push(self, name, node):
        self.stack.append((name, node))

    def close(self, names, confines):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] in names:
                del self.stack[i:]
                if len(names) > 1:
                    self.close(names, confines)
                return
            if self.stack[i][0] in confines:
                return


@pytest.mark.parametrize("seed", range(3))
def test_any_soup_gives_the_tree_of_looking_through_what_is_open(monkeypatch, seed):
    rnd = random.Random(seed)
    names = "html body head div p ul li table tr td th tbody tfoot dl dt dd section button svg g span a br form".split()
    soups = []
    for _ in range(150):
        tags = rnd.choices(names, k=rnd.randrange(1, 60))
        soups.append("".join(f"<{'/' * (rnd.random() < 0.4)}{t}>{rnd.choice(('', 'x', 'y z'))}" for t in tags))
    ours = [pages.parse(s) for s in soups]
    monkeypatch.setattr(pages, "_Open", _Listed)
    assert ours == [pages.parse(s) for s in soups]


@pytest.mark.parametrize("opening, ending", [("<div>", "</p>"), ("<section>", "</li>"), ("<div>", "<td>"), ("<button>", "<p>x")])
def test_deep_pages_take_time_in_proportion(opening, ending):
    def seconds(n):
        start = time.process_time()
        page = pages.parse(opening * n + "x" + ending * n)
        assert len(page.tags) > n
        return time.process_time() - start

    seconds(1_000)
    few, many = seconds(25_000), seconds(100_000)
    # In proportion it is four times as long, by looking through all sixteen times.
    assert many < 9 * few + 0.5 and many < 20


def test_blocks_of_lists_and_tables():
    assert [t for _, t in pages.parse("<table><tr><td>a<td>b<tr><td>c</table>d").blocks] == ["a", "b", "c", "d"]
    assert [t for _, t in pages.parse("<ul><li>one <i>x</i><li>two</ul>").blocks] == ["one x", "two"]
    assert [t for _, t in pages.parse("<p>a<div>b</div>c").blocks] == ["a", "b", "c"]


@pytest.mark.parametrize("name", ["button", "select", "object", "svg", "math", "noscript", "iframe", "template"])
def test_an_unclosed_element_hides_no_article(name):
    found = " ".join(t for _, t in pages.parse(f"<div><{name}>inner words</div><article><p>one two<p>three").blocks)
    assert found == "inner words one two three"
    found = pages.parse(f"<main><summary><{name}>x</summary><p>y</main>")
    assert [found.tags[n] for n, _ in found.blocks][-1] == "p" and found.depths[found.blocks[-1][0]] == 2
    found = pages.parse(f"<p>for <{name}>x <mi>y</mi></{name}> holds<p>next").blocks
    assert " ".join(t for _, t in found).split() == "for x y holds next".split()


def test_the_given_pages_give_their_articles(spark, model):
    import duckdb

    sources = [r[0] for r in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    for source, text in zip(sources, html_extract.texts_of(model, sources)):
        article = source[source.index("<article>") + 9 : source.index("</article>")]
        assert text == "\n".join(t for _, t in pages.parse(article).blocks)
