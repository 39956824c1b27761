"""The page model against brute force and held-out labelled pages."""

import itertools
import re
from html import unescape

import numpy as np
import pytest
from helpers import frame
from paths import SF

from leadcurve.llm import dom, extraction, layouts, queries

PAGES = "page_id bigint, url string, html string"


@pytest.fixture(scope="module")
def model():
    return extraction.default_model()


def marked_text(html):
    """The text of the elements that a labelled page marks."""
    f = extraction.forest([dom.parse(html)])
    tree, state = f.trees[0], extraction.labels(f)
    blocks = {}
    for node, name in enumerate(tree.names):
        if name == dom.TEXT and (state[node] == extraction.CONTENT or tree.texts[node].isspace()):
            blocks.setdefault(tree.blocks[node], []).append(tree.texts[node])
    return "\n\n".join(b for b in (" ".join("".join(p).split()) for _, p in sorted(blocks.items())) if b)


def article_text(html):
    """The blocks of the only article element, by its tags alone."""
    inner = re.search(r"<article>(.*?)(</article>|$)", html or "", re.S)
    if not inner:
        return ""
    pieces = re.split(r"</?(?:p|h1|h2|ul|li|div)[^>]*>", inner[1].replace("<br>", " "))
    return "\n\n".join(b for b in (" ".join(unescape(re.sub("<[^>]*>", "", p)).split()) for p in pieces) if b)


def texts(spark, *pages):
    df = extraction.extract(frame(spark, [(i, "u", p) for i, p in enumerate(pages)], PAGES))
    return [r.text for r in df.orderBy("page_id").collect()]


def test_messages_are_exact():
    """Marginals of a small tree against the sum over all assignments."""
    rng = np.random.default_rng(2)
    f = extraction.forest([dom.parse("<div><p>a <b>b</b></p>c</div>"), dom.parse("<p>x</p>")])
    model = extraction.Model(rng.normal(size=3), *(rng.normal(size=(extraction.N_GROUPS, 3, 3)) for _ in range(2)), [rng.normal(size=(3, n)) for n in extraction.FEATURES])
    belief, inner, both = model.solve(f)
    for a, b in itertools.pairwise(f.starts.tolist()):
        total, sums, pairs = 0.0, np.zeros((b - a, 3)), np.zeros((b - a, 3, 3))
        for states in itertools.product(range(3), repeat=b - a):
            energy = model.root[states[0]]
            for node in range(a, b):
                s = states[node - a]
                energy += sum(model.values[i][s, f.observed[node, i]] for i in range(len(extraction.FEATURES)))
                if f.parent[node] >= 0:
                    up = states[f.parent[node] - a]
                    energy += model.edges[f.group[node], up, s] + model.under[f.group[f.parent[node]], up, s] + extraction.RULES[up, s]
            weight = np.exp(energy)
            total += weight
            for node, s in enumerate(states):
                sums[node, s] += weight
                if f.parent[a + node] >= 0:
                    pairs[node, states[f.parent[a + node] - a], s] += weight
        assert np.allclose(belief[a:b], sums / total)
        for node, pair in zip(inner.tolist(), both, strict=True):
            if a <= node < b:
                assert np.allclose(pair, pairs[node - a] / total)


def test_learning_climbs():
    pages = layouts.labelled_pages(40, seed=3)
    f = extraction.forest([dom.parse(p) for p in pages])
    state = extraction.labels(f)
    text = state >= 0

    def missed(model):
        return float((model.solve(f)[0].argmax(1) != state)[text].mean())

    assert missed(extraction.train(pages, rounds=40)) < 0.02 < missed(extraction.train(pages, rounds=0))


def test_held_out_layouts(model):
    pages = layouts.labelled_pages(300, seed=77)
    found = extraction.main_texts(model, [dom.parse(re.sub(' data-label="[a-z]+"', "", p)) for p in pages])
    wanted = [marked_text(p) for p in pages]
    assert sum(a == b for a, b in zip(found, wanted, strict=True)) >= 0.95 * len(pages)


def test_table(spark):
    pages = {r.page_id: (r.url, r.html) for r in queries.table(spark, SF, "pages").collect()}
    rows = queries.op12_extraction(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id][0], article_text(pages[r.page_id][1]), len(r.text))


def test_blocks_and_references(spark):
    page = (
        "<html><head><title>No</title></head><body><nav><a href='/'>Home</a> <a href='/b'>More</a></nav><article><h1>A &amp; B&nbsp;&copy;</h1>"
        "<p>One\n two<br>three <b>fo</b>ur.</p><ul><li>Five words are here now.<li>Six.</ul><script>var a = '</p>';</script><!-- <p>gone</p> --></article><footer>&copy; x</footer>"
    )
    assert texts(spark, page) == ["A & B ©\n\nOne two three four.\n\nFive words are here now.\n\nSix."]


def test_parts_that_go(spark):
    head = '<body><header><h1>Site</h1></header><div class="cookie-banner"><p>We use cookies here.</p></div><div class="ad">Buy this now.</div><article><h1>The title stays</h1>'
    prose = "<p>This is the first sentence of it. And this is another one.</p><p>A second paragraph follows the first. It ends here.</p>"
    tail = '</article><aside class="sidebar"><h3>Popular</h3><ul><li><a href="/a">One story</a></li></ul></aside><form class="newsletter"><p>Sign up for more.</p><input></form>'
    tail += '<section class="comments"><h3>Comments</h3><div class="comment"><b>Ann</b><p>I do not agree with this. It is wrong.</p></div></section><footer>&copy; Site</footer></body>'
    assert texts(spark, head + prose + tail) == ["The title stays\n\nThis is the first sentence of it. And this is another one.\n\nA second paragraph follows the first. It ends here."]


def test_strange_pages(spark):
    deep = "<div>" * 3000 + "<p>Some words stand at the bottom of it. They are the text.</p>"
    long = "<article>" + "<p>" + "many words " * 50_000 + "end.</p></article>"
    found = texts(spark, None, "", "   ", "<", "<!-- open", "<script>var a", "</div></p>", deep, long, '<p class="a', "a < b and c > d are compared in this sentence.")
    assert len(found) == 11 and all(found[i] == "" for i in (0, 1, 2, 4, 5, 6, 9))
    assert len(found[8]) == len("many words " * 50_000 + "end.")


def test_rows_and_columns(spark):
    page = "<article><h1>Title of it</h1><p>A sentence for the text. Another one.</p></article>"
    rows = [(1, None, page, 1, "x"), (1, None, page, 1, "x"), (None, "u", page, None, None)]
    df = extraction.extract(frame(spark, rows, f"{PAGES}, n_chars int, text string"))
    assert df.columns == ["page_id", "url", "text", "n_chars"]
    assert [(r.page_id, r.url) for r in df.collect()] == [(1, None), (1, None), (None, "u")]
    assert extraction.extract(frame(spark, [], PAGES)).collect() == []


@pytest.mark.parametrize(
    ("html", "wanted"),
    [
        ("<p>a<p>b", [("a", 1), ("b", 2)]),
        ("<b>a<p>b</b>c</p>d", [("a", 0), ("b", 1), ("c", 1), ("d", 2)]),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", [("a", 2), ("b", 4), ("c", 6)]),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", None),
        ('<a title="x>y">a</a>', [("a", 0)]),
        ("<a title=x>y>a", [("y>a", 0)]),
        ("x<style>p{}</style>y", [("x", 0), ("y", 0)]),
        ("<svg><text>a</text></svg>b", [("b", 0)]),
        ("<head><title>t</title>a", [("a", 1)]),
    ],
)
def test_trees(html, wanted):
    tree = dom.parse(html)
    found = [(t, b) for n, t, b in zip(tree.names, tree.texts, tree.blocks, strict=True) if n == dom.TEXT]
    if wanted is None:
        assert [t for t, _ in found] == ["a", "b", "c", "d"] and len({b for _, b in found}) == 4
    else:
        assert [t for t, _ in found] == [t for t, _ in wanted] and [b for _, b in found] == sorted(b for _, b in found)
        assert len({b for _, b in found}) == len({b for _, b in wanted})
