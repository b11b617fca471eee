"""Main text: composed pages that were not trained on, the parser's awkward cases, and exact marginals."""

import html
import itertools
import re
import time

import pytest

from quillon.llm import html_tree
from tests.llm import fixtures


@pytest.fixture(scope="module")
def model():
    return html_tree.trained()


def test_composed_pages(model):
    exact = 0
    for seed in range(50_000, 50_200):
        page = html_tree.labelled_page(seed)
        want = [x.text.replace(html_tree.MARK, "").strip() for x in html_tree.parsed(page) if x.tag == "#" and x.text.startswith(html_tree.MARK)]
        exact += model.main_text(page.replace(html_tree.MARK, "")) == "\n\n".join(want)
    assert exact >= 195


def test_synthetic_table(spark):
    path = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{path}/pages.parquet").collect()}
    rows = html_tree.op1_dom_tree_extraction(spark, path).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|<footer|$)", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


PAGE = """<!doctype html><body><nav class=menu><a href=/>Home</a><a href=/a>About</a></nav><div id='cookie-notice'><p>We use cookies, as you know. Accept.</p></div>
<main><h1>Caf&eacute; &amp; co</h1><p>First <b>para<i>graph</b></i> has
  several\twords, and commas. It goes on.<p>Second one is unclosed, but fine &lt;here&gt;. More text.<div class="ad">Buy this thing now!</div>
<script>document.write("<p>not this</p>")</script><style>p{}</style><!-- <p>nor this</p> --><form><p>Sign up here for news</p><input><button>Go</button></form>
<section id=comments><div class=comment><b>joe</b><p>I liked it, very much. Thanks!</p></div></section></main><aside><h3>Related</h3><p>Other things, of note.</p></aside><footer>&copy; 2020 Site</footer>"""


def test_parts_of_a_page(model):
    want = "Café & co\n\nFirst paragraph has several words, and commas. It goes on.\n\nSecond one is unclosed, but fine <here>. More text."
    assert model.main_text(PAGE) == want
    assert model.main_text(PAGE + "<p") == want and model.main_text(PAGE + "<!-- open") == want


@pytest.mark.parametrize("page", [None, "", "<", "<p", "</p></div>", "<script>", "<!--", "<a><b><table><td></b></a>", "<div>" * 3000 + "x", "plain text only"])
def test_odd_markup(model, page):
    assert isinstance(model.main_text(page), str)


def test_any_cut_is_survived(model):
    for at in range(0, len(PAGE), 17):
        model.main_text(PAGE[:at])


STORY = (
    "<html><body><nav><a href=/>Home</a> <a href=/b>Blog</a></nav><article><h1>Title here</h1><p>First paragraph of the story, long enough to be read. It goes on.</p>"
    "{}<p>Second paragraph, which says more. It ends here.</p></article><footer>&copy; 2020 Site. All rights reserved.</footer></body></html>"
)
COOKIES = "We use cookies to improve your visit. "


@pytest.mark.parametrize(("inner", "kept"), [
    ("<section><h2>Part</h2><p>Full sentences in a section. They are text.</p></section>", ["Part", "Full sentences in a section. They are text."]),
    ("<section>Sentences directly in it. They are text.</section>", ["Sentences directly in it. They are text."]),
    ("<div>Text standing directly in a div.</div>", ["Text standing directly in a div."]), ("<h4>Small heading</h4>", ["Small heading"]),
    ("<ul><li>red</li><li>green</li><li>blue</li></ul>", ["red", "green", "blue"]), ("<pre>x = 1\ny = 2</pre>", ["x = 1 y = 2"]),
    ("<table><tr><th>Name</th><th>Age</th></tr><tr><td>Ann</td><td>31</td></tr></table>", ["Name", "Age", "Ann", "31"]),
    ("<figure><img src=a><figcaption>A photo</figcaption></figure>", ["A photo"]), ("<p title=it's>Odd attribute.</p><p>It's next.</p>", ["Odd attribute.", "It's next."]),
    ("<p>She baked cookies for us all.</p>", ["She baked cookies for us all."]), ("<div class='ad'>Buy this now.</div>", []),
    ("<div class=related><h3>Related</h3><ul><li><a href=/a>Other story</a></ul></div>", []), ("<section class=comments><h3>Comments</h3><p>I loved this. Thanks!</p></section>", []),
    *((f"<div{name}>{COOKIES * n}</div>", []) for n in (5, 7, 8, 9, 20) for name in ("", " class='cookie-notice'")),
])
def test_blocks_of_an_article(model, inner, kept):
    ends = ["Title here", "First paragraph of the story, long enough to be read. It goes on."], ["Second paragraph, which says more. It ends here."]
    assert model.main_text(STORY.format(inner)) == "\n\n".join([*ends[0], *kept, *ends[1]])


@pytest.mark.parametrize("parts", [("<i>x", "</u>y"), ("<i>", "<div>y</div>"), ("<div>", "<li>y</li>"), ("<p title='>", ""), ("<table>", "<tr>a"), ("<ul><li>", "</p>"), ("<a href=\"x", "</a>")])
def test_a_megabyte_of_hostile_markup(model, parts):
    n = 1_000_000 // len("".join(parts))
    began = time.process_time()
    model.main_text(parts[0] * n + parts[1] * n)
    assert time.process_time() - began < 8  # quadratic time would take a quarter of an hour


def test_marginals_are_exact(model):
    """Against the sum over all labellings of a small tree."""
    nodes = html_tree.parsed("<div class=content><p>Some text, here. And more of it to read.</p><p>x</p></div><div class=ad><a>buy</a></div>")
    n, got = len(nodes), model.marginals(nodes)
    m = html_tree.Model.__new__(html_tree.Model)
    m.ratio, m.edge = {}, model.edge  # edges alone
    only = html_tree.Model.marginals(m, nodes)
    assert only != got
    total, on = 0.0, [0.0] * n
    for labels in itertools.product((0, 1), repeat=n):
        p = 1.0
        for i in range(1, n):
            p *= model.edge.get(html_tree.kind_of(nodes[i]), model.edge["*"])[labels[nodes[i].parent]][labels[i]]
        total += p
        on = [a + p * y for a, y in zip(on, labels, strict=True)]
    assert all(abs(a / total - b) < 1e-9 for a, b in zip(on, only, strict=True))


def test_null_repeated_and_empty(spark, tmp_path):
    rows = [(1, "u", None, "a"), (1, "u", None, "a"), (None, None, "", "b"), (2, "v", "<p>" + "Long words, here. " * 20_000, "c")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.n_chars) for r in html_tree.extract_main_text(frame).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 359_999)]
    assert html_tree.op1_dom_tree_extraction(spark, fixtures.empty(spark, tmp_path)).count() == 0




LONG_A = "A paragraph that has some words in it, commas too, and goes on for a while so that it is long enough to count as text here."
LONG_B = "Another paragraph says more about this; it is, as the first one, about a hundred and twenty characters long, or so I hope."


@pytest.mark.parametrize("n", [1, 2, 3])
@pytest.mark.parametrize("tag", ["article", "main", "div", "div class='content'"])
def test_linked_lists_stay(model, tag, n):
    items = [f"Linked item {i}" for i in range(n)]
    inner = f"<p>{LONG_A}</p><p>{LONG_B}</p><ul>" + "".join(f"<li><a href=/{i}>{x}</a></li>" for i, x in enumerate(items)) + "</ul>"
    page = f"<html><body><nav><a href=/>Home</a></nav><{tag}>{inner}</{tag.split()[0]}><footer>&copy; 2020 X. All rights reserved.</footer></body></html>"
    assert model.main_text(page) == "\n\n".join([LONG_A, LONG_B, *items])


@pytest.mark.parametrize(("page", "want"), [
    (f"<div class=xq><h1>Some heading</h1><p>{LONG_A}</p></div>", ["Some heading", LONG_A]),
    (f"<div class=xq><h1>Some heading</h1><p>{LONG_A}</p><p>{LONG_B}</p><p>{LONG_A}</p></div>", ["Some heading", LONG_A, LONG_B, LONG_A]),
    ("<div class=xq><h1>Ein Titel</h1><p>Ein kurzer Absatz, mehr nicht.</p></div>", ["Ein Titel", "Ein kurzer Absatz, mehr nicht."]),
    (f"<article><h1>T</h1><p>{LONG_A}</p><p>{LONG_B}</p></article><section><h3>3 thoughts on this</h3><p>I liked it a lot, thanks.</p><p>Me too, really. Well done!</p></section>", ["T", LONG_A, LONG_B]),
    (f"<article><h1>T</h1><p>{LONG_A}</p><p>{LONG_B}</p><section><h3>3 thoughts on this</h3><p>I liked it a lot, thanks.</p><p>Me too, really. Well done!</p></section></article>", ["T", LONG_A, LONG_B]),
    (f"<article><header><h1>Own title</h1></header><p>{LONG_A}</p><p>{LONG_B}</p></article>", ["Own title", LONG_A, LONG_B]),
    (f"<header><a href=/>Site</a><p>A motto</p></header><article><header><h1>Own title</h1></header><p>{LONG_A}</p></article><footer>&copy; me</footer>", ["Own title", LONG_A]),
])
def test_unknown_names_comments_and_headers(model, page, want):
    assert model.main_text(page) == "\n\n".join(want)


def other_page(seed):
    """A page of another author: (html, runs of its article, other runs). Shares nothing with the model's own composer."""
    rng = __import__("random").Random(f"other {seed}")
    words = "time river stone people small house under many water again light story never garden winter paper great market letter answer".split()
    said = lambda a, b: " ".join(rng.choice(words) for _ in range(rng.randint(a, b)))
    full = lambda: ". ".join(said(6, 18).capitalize() for _ in range(rng.randint(2, 5))) + "."
    keep, drop = [], []

    def run(text, into):
        into.append(text)
        return text

    def article():
        out = f"<h1>{run(said(2, 6).capitalize(), keep)}</h1>"
        if layout == 2:
            out = f"<header>{out}</header>"
        for _ in range(rng.randint(3, 9)):
            kind = rng.random()
            if kind < 0.6:
                out += f"<p>{run(full(), keep)}</p>\n"
            elif kind < 0.7:
                out += f"<h2>{run(said(2, 5).capitalize(), keep)}</h2>"
            elif kind < 0.8:
                out += "<ul>" + "".join(f"<li>{run(said(3, 9), keep)}</li>" for _ in range(3)) + "</ul>"
            elif kind < 0.86:
                out += "<ol>" + "".join(f"<li><a href='#'>{run(said(2, 5), keep)}</a></li>" for _ in range(2)) + "</ol>"
            elif kind < 0.93:
                out += f"<blockquote><p>{run(full(), keep)}</p></blockquote>"
            else:
                out += f"<table><tr><td>{run(said(1, 3), keep)}</td><td>{run(said(1, 3), keep)}</td></tr></table>"
        return out

    layout = rng.randrange(3)
    menu = "".join(f"<li><a href='/{i}'>{run(said(1, 2), drop)}</a></li>" for i in range(rng.randint(3, 7)))
    foot = run(f"© {rng.randint(1999, 2025)} {said(1, 3)}. All rights reserved.", drop)
    side = f"<h4>{run('Related', drop)}</h4><ul>" + "".join(f"<li><a href='/r{i}'>{run(said(3, 7), drop)}</a></li>" for i in range(4)) + "</ul>"
    voices = "".join(f"<div class='comment'><p>{run(full(), drop)}</p></div>" for _ in range(rng.randint(1, 4)))
    said_by = f"<h3>{run(f'{rng.randint(2, 9)} comments', drop)}</h3>{voices}"
    ask = f"<p>{run('Subscribe to our newsletter, and read more of this.', drop)}</p>"
    if layout == 0:
        page = f"<div id='navbar'><ul>{menu}</ul></div><div class='post-body'>{article()}</div><div class='sidebar'>{side}</div><div id='comments'>{said_by}</div><div class='footer'>{foot}</div>"
    elif layout == 1:
        page = f"<nav><ul>{menu}</ul></nav><main><article>{article()}</article></main><aside>{side}</aside><div class='newsletter'>{ask}</div><footer>{foot}</footer>"
    else:
        page = f"<header><ul>{menu}</ul></header><article>{article()}</article><section class='comments'>{said_by}</section><footer><p>{foot}</p></footer>"
    return f"<!DOCTYPE html><html><head><title>x</title></head><body>{page}</body></html>", keep, drop


def test_pages_of_another_author(model):
    kept = lost = foreign = total = 0
    for seed in range(300):
        page, keep, drop = other_page(seed)
        found = model.main_text(page).split("\n\n")
        want = {k: keep.count(k) for k in keep}
        for run in found:
            if want.get(run, 0) > 0:
                want[run] -= 1
            else:
                foreign += len(run)
        total += sum(map(len, keep))
        lost += sum(len(k) * n for k, n in want.items())
        kept += sum(map(len, found))
    assert lost <= 0.02 * total and foreign <= 0.02 * kept
