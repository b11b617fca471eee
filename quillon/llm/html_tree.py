"""Main text of pages by a tree-structured graphical model over the DOM.

A page becomes a tree of its block elements, whose leaves are runs of text. Every
node has a hidden label: content (for an element: holds content) or not. Node potentials come from what is seen
at it (words of class, id and role; a run's length, links, sentences and words of notices); an edge's
potential is the probability of the child's label given the parent's and the
child's kind. Both are estimated from labelled pages. Messages are passed once
from the leaves up and once from the root down (sum-product), which gives the
exact marginal of every node; runs that are content with a probability of one
half or more make the text.

No labelled pages come with the corpus, so the labelled ones are composed here
by rule (``labelled_page``): page layouts with and without telling tags, whose runs
are marked as they are written. Articles hold paragraphs, headings, sections, plain
divisions, lists, tables, code, figures and quotes, and parts that are no content.

Parsing and messages take time in proportion to a page's length, whatever its markup.

Defined cases: null and empty pages, and pages without text, give the empty
text; markup may be unclosed, misnested or cut off; repeated rows are each
returned; an empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import random
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quillon.llm.common import read_table

# Element names of HTML by their part in a page.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot"
    " th thead tr ul button".split()
)
NEVER = frozenset("button head option select svg math canvas audio video object map datalist".split())
TABLE = frozenset("table tr tbody thead tfoot td th body html".split())
ENDS, PARTED = frozenset(("header", "footer")), frozenset(("article", "section", "main"))
#: A start tag closes these, up to the elements that hold it back.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "body": ({"head"}, set()),
    "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
#: A quote opens a value only after "="; an unclosed one is a sign like others, so that a tag ends at some ">".
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)(?:>|\Z)", re.S)
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
WORD = re.compile(r"[a-z]+")
CLUES = re.compile(r"©|\bcopyright\b|\bcookies?\b|\bsubscribe\b|\bsign up\b|\bnewsletter\b|\ball rights reserved\b|\bread more\b|\blog ?in\b|\bprivacy\b|\breply\b|\breplies\b|\badvert|\bcomments?\b|\bresponses?\b|\bthoughts? on\b|\bleave a\b|\bsays:")
#: What stands over readers' comments.
HEADS = re.compile(r"(?:\d+ )?(?:comments?|responses?|replies|thoughts? on .{1,80}|leave a (?:reply|comment))(?: \(\d+\))?[.:]?")
#: Stands before text that is content, in labelled pages only.
MARK = "\ue000"


class Node:
    __slots__ = ("inside", "links", "names", "parent", "tag", "text")

    def __init__(self, tag: str, parent: int, names: tuple[str, ...] = (), text: str = "", links: int = 0, inside: bool = False):
        self.tag, self.parent, self.names, self.text, self.links = tag, parent, names, text, links
        self.inside = inside  # a header or footer of an article, a section or the main part


class _Open:
    """The open elements that matter: blocks, and what hides its content. Each step takes constant time, spread over all."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = [("#root", 0)]  # names, with the block node that they are in
        self.places: dict[str, list[int]] = defaultdict(list)
        self.never = 0  # the stack's height with the outermost hiding element, or 0

    def push(self, tag: str, node: int) -> None:
        self.places[tag].append(len(self.stack))
        self.stack.append((tag, node))

    def last(self, tags) -> int:
        """The place of the innermost of some names; 0 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def first_after(self, tags, place: int) -> int:
        """The place of the outermost of some names beyond a place; 0 if there is none."""
        found = [p[i] for t in tags if (p := self.places.get(t)) and (i := bisect_right(p, place)) < len(p)]
        return min(found, default=0)

    def cut(self, place: int) -> bool:
        """Closes the element at a place and all in it; tells whether a block was among them."""
        block = False
        while len(self.stack) > place:
            tag, _ = self.stack.pop()
            self.places[tag].pop()
            block |= tag in BLOCK
        if self.never > place:
            self.never = 0
        return block


def parsed(page: str) -> list[Node]:
    """The block elements and runs of a page, parents first. Runs have the tag "#"; the root is node 0."""
    nodes = [Node("#root", -1)]
    opened = _Open()
    run: list[str] = []
    links, link = 0, 0  # characters of the run inside links; the stack's height where a link is open, or 0

    def ended():
        nonlocal links
        if run:
            text = " ".join("".join(run).split())
            if text:
                nodes.append(Node("#", opened.stack[-1][1], (), text, min(links, len(text))))
            run.clear()
        links = 0

    def closed(place: int):
        nonlocal link
        # the run belongs to the innermost block, so it ends before that is closed
        if any(t in BLOCK for t, _ in opened.stack[place:]):
            ended()
        opened.cut(place)
        if link > place:
            link = 0

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        upto = m.start() if m else end
        if upto > at and not opened.never:
            text = page[at:upto]
            text = html.unescape(text) if "&" in text else text
            run.append(text)
            if link:
                links += len(text.strip())
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            place = opened.last((tag,))
            if place:
                if tag in TABLE or opened.last(("td", "th", "table")) <= place:
                    closed(place)
            elif tag == "a":
                link = 0
            elif tag in ("p", "br") and not opened.never:
                ended()
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag == "br":
            run.append(" ")
            continue
        if tag == "hr":
            ended()
            continue
        if tag in VOID:
            continue
        if tag in CLOSES:
            closes, holds = CLOSES[tag]
            place = opened.first_after(closes, opened.last(holds))
            if place:
                closed(place)
        if (tag in BLOCK or tag in NEVER) and opened.stack[-1][0] == "p" and not opened.never:
            closed(len(opened.stack) - 1)
        attributes = m[3]
        hiding = tag in NEVER or bool(attributes and HIDDEN.search(attributes))
        if attributes.endswith("/") and tag not in BLOCK:
            continue
        if opened.never:
            if tag in BLOCK or tag in NEVER:
                opened.push(tag, opened.stack[-1][1])
        elif hiding:
            ended()
            opened.push(tag, opened.stack[-1][1])
            opened.never = len(opened.stack)
        elif tag in BLOCK:
            ended()
            names = tuple(dict.fromkeys(w for v in NAMES.findall(attributes) for w in WORD.findall(v.lower()))) if attributes else ()
            inside = tag in ENDS and nodes[opened.stack[-1][1]].tag in PARTED
            nodes.append(Node(tag, opened.stack[-1][1], names, inside=inside))
            opened.push(tag, len(nodes) - 1)
        elif tag == "a":
            link = len(opened.stack)
    if not opened.never:
        ended()
    return nodes


# Steps of what is measured, and the names of the steps' ranges.
SHARES, CHARS, STOPS = (0.05, 0.35, 0.75), (25, 80, 200, 600), (1, 3, 6)
COMMENTS = "run heads comments"
RUN_LINKS, BLOCK_LINKS = [f"run links {k}" for k in range(4)], [f"block links {k}" for k in range(4)]
RUN_SHAPE = [[f"run chars {k} stops {j}" for j in range(4)] for k in range(5)]
HOLDERS = frozenset("div section dl table td".split())
#: Clues among a run's characters, by the hundred.
RATES, RUN_CLUES = (0.15, 0.6, 1.2, 1.8, 2.6), [[f"run chars {k} clues {j}" for j in range(6)] for k in range(5)]


def observations(nodes: list[Node]) -> list[list[str]]:
    """What is seen at each node, as strings."""
    n = len(nodes)
    chars, links = [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        x = nodes[i]
        if x.tag == "#":
            chars[i], links[i] = len(x.text), x.links
        chars[x.parent] += chars[i]
        links[x.parent] += links[i]
    out = []
    for i, x in enumerate(nodes):
        # an element with one run would only say again what the run says
        if x.tag == "#":
            text = x.text
            stops = text.count(".") + text.count(",") + text.count("!") + text.count("?")
            seen = [RUN_LINKS[bisect_right(SHARES, x.links / chars[i])]]
            clues = sum(1 for _ in CLUES.finditer(text.lower()))
            size = bisect_right(CHARS, chars[i])
            if HEADS.fullmatch(text.lower()):
                out.append([COMMENTS])
                continue
            # one observation, as length, sentences and clues depend on each other
            seen.append(RUN_CLUES[size][bisect_right(RATES, 100 * clues / chars[i])] if clues else RUN_SHAPE[size][bisect_right(STOPS, stops)])
        else:
            seen = ["name " + w for w in x.names] if i else ["page"]
            if x.tag in HOLDERS:
                seen.append(BLOCK_LINKS[bisect_right(SHARES, links[i] / chars[i] if chars[i] else 0.0)])
        out.append(seen)
    return out


def shares(nodes: list[Node]) -> list[float]:
    """How much each node's observations count: the items of a list are alike, so that all of them together say what one does."""
    items = Counter(x.parent for x in nodes if x.tag == "li")
    return [1 / items[nodes[x.parent].parent] if x.tag == "#" and nodes[x.parent].tag == "li" else 1.0 for x in nodes]


def kind_of(x: Node) -> str:
    """What an edge's potential depends on: the child's tag, and whether class, id or role say more of it in words that layouts commonly use."""
    kind = x.tag + " inside" if x.inside else x.tag
    return kind + " named" if not TELLING.isdisjoint(x.names) else kind


#: Counts that every label pair of an edge starts with, and the most that a node's own observations weigh for content (log-ratio); against it, twice as much, or thrice for a heading of comments.
PRIOR, MOST = 0.01, 4.0
#: The least log-ratio of a block without a name, whose runs tell what they are themselves.
UNNAMED_LEAST = -1.0
#: The least log-ratio of a list's items together: links alone do not take a list out of an article, nor the article with it.
LIST_LEAST = -2.0
#: Instead of 0, so that no sum vanishes: the probability of content below an element that holds none.
NEVER_BELOW = 1e-9


class Model:
    """Log-ratios of what is seen, and edge potentials by the child's tag, from labelled pages."""

    def __init__(self, pages: list[str]):
        seen: dict[str, list[float]] = defaultdict(lambda: [0.5, 0.5])
        edges: dict[str, list[list[float]]] = defaultdict(lambda: [[PRIOR, PRIOR], [PRIOR, PRIOR]])
        labels_of = Counter()
        for page in pages:
            nodes = parsed(page)
            labels = labels_in(nodes)
            for x in nodes:
                x.text = x.text.replace(MARK, "")
            for i, (x, what, share) in enumerate(zip(nodes, observations(nodes), shares(nodes), strict=True)):
                y = labels[i]
                labels_of["run" if x.tag == "#" else "block", y] += share
                for w in what:
                    seen[w][y] += share
                if x.parent >= 0:
                    for kind in (kind_of(x), "*"):
                        edges[kind][labels[x.parent]][y] += 1
        size = {k: [max(labels_of[k, 0], 1), max(labels_of[k, 1], 1)] for k in ("run", "block")}
        self.ratio = {}
        for w, (off, on) in seen.items():
            n = size["run" if w.startswith("run") else "block"]
            self.ratio[w] = math.log(on / n[1]) - math.log(off / n[0])
        # an element that holds no content has none below it
        self.edge = {t: ((1 - NEVER_BELOW, NEVER_BELOW), tuple(v / sum(m[1]) for v in m[1])) for t, m in edges.items()}

    def marginals(self, nodes: list[Node]) -> list[float]:
        """The probability of content for every node, by one pass up and one down."""
        n = len(nodes)
        any_edge = self.edge["*"]
        get = self.ratio.get
        kinds = list(map(kind_of, nodes))
        on = []
        for x, what, share in zip(nodes, observations(nodes), shares(nodes), strict=True):
            weight = sum(get(w, 0.0) for w in what)
            weight = weight if share == 1 and nodes[x.parent].tag != "li" else share * max(LIST_LEAST, weight)
            on.append(math.exp(max(-3 * MOST if what[:1] == [COMMENTS] else -2 * MOST, min(MOST, weight)) if x.tag == "#" else max(-2 * MOST if x.names else UNNAMED_LEAST, min(MOST if x.names or x.parent < 0 else 1.0, weight))))
        up0, up1 = [1.0] * n, on  # what the node and all below it say of its label
        to0, to1 = [1.0] * n, [1.0] * n  # what it says of its parent's label
        for i in range(n - 1, 0, -1):
            s = up0[i] + up1[i]
            a, b = up0[i] / s, up1[i] / s
            up0[i], up1[i] = a, b
            e = self.edge.get(kinds[i], any_edge)
            to0[i], to1[i] = e[0][0] * a + e[0][1] * b, e[1][0] * a + e[1][1] * b
            p = nodes[i].parent
            up0[p] *= to0[i]
            up1[p] *= to1[i]
            s = up0[p] + up1[p]
            up0[p] /= s
            up1[p] /= s
        down0, down1 = [1.0] * n, [1.0] * n  # what all the rest says of its label
        out = [0.0] * n
        for i in range(n):
            if i:
                p = nodes[i].parent
                a, b = up0[p] * down0[p] / max(to0[i], 1e-300), up1[p] * down1[p] / max(to1[i], 1e-300)
                s = a + b
                a, b = a / s, b / s
                e = self.edge.get(kinds[i], any_edge)
                down0[i], down1[i] = a * e[0][0] + b * e[1][0], a * e[0][1] + b * e[1][1]
            off, yes = up0[i] * down0[i], up1[i] * down1[i]
            out[i] = yes / (off + yes) if off + yes else 0.0
        return out

    def main_text(self, page: str | None) -> str:
        if not page:
            return ""
        nodes = parsed(page)
        found = self.marginals(nodes)
        return "\n\n".join(x.text for x, p in zip(nodes, found, strict=True) if x.tag == "#" and p >= 0.5)


def labels_in(nodes: list[Node]) -> list[int]:
    """Labels of a labelled page: a run's by its mark; an element is content if it holds any."""
    out = [int(x.text.startswith(MARK)) for x in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        out[nodes[i].parent] |= out[i]
    return out


# Words that layouts commonly give the parts of a page as class or id.
PARTS = {
    "menu": "nav navbar navigation menu topnav breadcrumb breadcrumbs toc tabs pagination pager toolbar",
    "header": "header masthead banner top site branding logo topbar",
    "footer": "footer bottom colophon copyright legal site",
    "sidebar": "sidebar aside widget rail related recommended popular tags secondary complementary column",
    "notice": "notice cookie consent gdpr alert banner popup modal message warning",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adsense",
    "form": "form search login newsletter subscribe signup contact",
    "share": "share social buttons meta byline author tools",
    "comments": "comments comment discussion replies respond disqus reader responses",
    "content": "content article post entry main story body text page hentry",
}


#: All these words.
TELLING = frozenset(w for words in PARTS.values() for w in words.split())

SAYINGS = (
    "we use cookies to improve your visit", "by continuing you accept our privacy policy", "subscribe to our newsletter", "sign up for free", "all rights reserved",
    "read more", "log in to reply", "this is an advertisement", "your privacy matters to us", "accept all cookies",
)


class _Author:
    """Composes one page; ``MARK`` stands before each run that is content."""

    SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi xo zu an er in on st".split()

    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.semantic = self.rng.random() < 0.6
        self.nameless = self.rng.random() < 0.2  # a layout whose names say nothing; its tags do
        self.semantic |= self.nameless

    def word(self) -> str:
        return "".join(self.rng.choice(self.SYLLABLES) for _ in range(self.rng.randrange(1, 4)))

    def words(self, a: int, b: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randrange(a, b)))

    def sentences(self, k: int) -> str:
        return " ".join(self.words(4, 22).capitalize() + self.rng.choice(("...", ".", ".", ".", "!", "?")) for _ in range(k))

    def sayings(self, k: int) -> str:
        return " ".join(f"{self.rng.choice(SAYINGS).capitalize()}{self.rng.choice(('.', ' ' + self.words(1, 9) + '.'))}" for _ in range(k))

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def names(self, part: str) -> str:
        chosen = [self.word() + self.word()] if self.nameless else self.rng.sample(PARTS[part].split(), 1 + self.chance(0.35))
        return f' {self.rng.choice(("class", "class", "id"))}="{self.rng.choice(("-", " ", "_")).join(chosen)}"'

    def box(self, part: str, tag: str, inner: str) -> str:
        tag = tag if self.semantic else "div"
        telling = tag in ("nav", "header", "footer", "aside", "form", "article", "main")
        return f"<{tag}{'' if telling and self.chance(0.5) else self.names(part)}>{inner}</{tag}>"

    def links(self, k: int) -> str:
        items = [f'<a href="/{self.word()}">{self.words(1, 5)}</a>' for _ in range(k)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.chance(0.7) else " | ".join(items)

    # what is not content

    def menu(self) -> str:
        return self.box("menu", "nav", self.links(self.rng.randrange(3, 9)))

    def header(self) -> str:
        motto = f"<p>{self.words(2, 6)}</p>" if self.chance(0.5) else ""
        return self.box("header", "header", f"<a href='/'>{self.words(1, 3)}</a>{motto}{self.menu() if self.chance(0.5) else ''}")

    def footer(self) -> str:
        inner = self.rng.choice((f"&copy; {self.words(1, 4)}. {self.sentences(self.rng.randrange(1, 3))}", self.links(4), f"<p>Copyright {self.words(2, 5)}</p>{self.links(3)}", self.sayings(2)))
        return self.box("footer", "footer", inner)

    def sidebar(self) -> str:
        return self.box("sidebar", "aside", f"<h3>{self.words(1, 4)}</h3>{self.rng.choice((self.links(5), f'<p>{self.sentences(2)}</p>'))}")

    def notice(self) -> str:
        text = self.rng.choice((self.sayings(self.rng.randrange(1, 9)), self.sentences(self.rng.randrange(1, 3))))
        text = text if self.chance(0.4) else f"<p>{text}</p>"
        if self.chance(0.15):  # told by its words alone
            return f"<div>{self.sayings(self.rng.randrange(2, 40))}</div>"
        return self.box("notice", "div", text + self.rng.choice(("<button>OK</button>", "")))

    def ad(self) -> str:
        inner = self.rng.choice((self.sentences(self.rng.randrange(1, 3)), f"<p>{self.sentences(1)}</p>", f'<a href="/{self.word()}">{self.words(2, 8)}</a>'))
        return self.box("ad", self.rng.choice(("div", "aside")), inner)

    def form(self) -> str:
        return self.box("form", "form", f"<label>{self.words(1, 4)}</label><input type='text'><p>{self.words(3, 9)}</p><button>{self.word()}</button>")

    def share(self) -> str:
        return self.box("share", "div", self.rng.choice((self.links(3), f"{self.words(1, 3)} {self.rng.randrange(1, 28)} {self.word()}")))

    def comments(self) -> str:
        one = lambda: f"<div class='comment'><b>{self.word()}</b><p>{self.sentences(self.rng.randrange(1, 4))}</p></div>" if self.chance(0.7) else f"<li>{self.sentences(2)}</li>"
        some = "".join(one() for _ in range(self.rng.randrange(1, 5)))
        if self.nameless or self.chance(0.25):  # told by the heading alone
            saying = self.rng.choice(("{} thoughts on this", "{} comments", "{} responses", "Comments", "Leave a reply", "Replies", "{} thoughts on " + self.words(1, 6)))
            some = "".join(f"<{tag}>{self.sentences(self.rng.randrange(1, 4))}</{tag}>" for tag in [self.rng.choice(("p", "div", "li"))] * self.rng.randrange(1, 5))
            tag = self.rng.choice(("section", "div"))
            return f"<{tag}><h3>{saying.format(self.rng.randrange(1, 90))}</h3>{some}</{tag}>"
        return self.box("comments", "section", f"<h3>{self.words(1, 3)}</h3>" + some)

    # what is content

    def line(self) -> str:
        """A run of one or more sentences, some with a link, a stress, a line break or a word that also stands in notices."""
        text = self.sentences(self.rng.randrange(1, 7))
        cut = text.split(" ")
        at = self.rng.randrange(len(cut))
        if self.chance(0.3):
            cut[at] = self.rng.choice((f'<a href="#">{cut[at]}</a>', f"<b>{cut[at]}</b>", f"<em>{cut[at]}</em>"))
        elif self.chance(0.08):
            cut[at] = self.rng.choice(("cookies", "reply", "privacy", "copyright", "newsletter", "subscribe"))
        text = " ".join(cut)
        return MARK + (text.replace(". ", ".<br>", 1) if self.chance(0.2) else text)

    def short(self) -> str:
        return MARK + self.words(1, 5)

    def linked(self) -> str:
        """A run that is a link, or a link with some words before or behind it."""
        before, behind = self.rng.choice((("", ""), ("", ""), (self.words(1, 4) + " ", ""), ("", " " + self.words(1, 8))))
        return f'{MARK}{before}<a href="/{self.word()}">{self.words(1, 6)}</a>{behind}'

    def either(self) -> str:
        return self.short() if self.chance(0.5) else self.line()

    def paragraph(self) -> str:
        return f"<p>{self.line()}" + ("</p>" if self.chance(0.9) else "")

    def heading(self) -> str:
        tag = self.rng.choice(("h2", "h2", "h3", "h4", "h5", "h6"))
        return f"<{tag}>{MARK}{self.words(1, 8)}</{tag}>"

    def listing(self) -> str:
        tag, of = self.rng.choice(("ul", "ol")), self.rng.choice((self.short, self.line, self.linked))
        return f"<{tag}>" + "".join(f"<li>{of()}" + ("</li>" if self.chance(0.9) else "") for _ in range(self.rng.randrange(1, 7))) + f"</{tag}>"

    def terms(self) -> str:
        return "<dl>" + "".join(f"<dt>{self.short()}</dt><dd>{self.either()}</dd>" for _ in range(self.rng.randrange(1, 5))) + "</dl>"

    def table(self) -> str:
        of, width = self.rng.choice((self.short, self.short, lambda: MARK + str(self.rng.randrange(10_000)), self.line)), self.rng.randrange(2, 5)
        head = "<tr>" + "".join(f"<th>{self.short()}</th>" for _ in range(width)) + "</tr>" if self.chance(0.6) else ""
        rows = "".join("<tr>" + "".join(f"<td>{of()}</td>" for _ in range(width)) + "</tr>" for _ in range(self.rng.randrange(1, 6)))
        rows = f"<thead>{head}</thead><tbody>{rows}</tbody>" if head and self.chance(0.5) else head + rows
        caption = f"<caption>{self.either()}</caption>" if self.chance(0.3) else ""
        return f"<table>{caption}{rows}</table>"

    def code(self) -> str:
        return f"<pre>{MARK}" + "\n".join(self.words(1, 7) for _ in range(self.rng.randrange(1, 8))) + "</pre>"

    def figure(self) -> str:
        return f"<figure><img src='/{self.word()}'><figcaption>{self.either()}</figcaption></figure>"

    def quote(self) -> str:
        return f"<blockquote>{self.rng.choice((self.paragraph, self.line))()}</blockquote>"

    def group(self, depth: int) -> str:
        """A section or a division, with a heading, text of its own and blocks, or some of these."""
        tag = self.rng.choice(("section", "div"))
        heading = self.heading() if self.chance(0.4) else ""
        inner = self.either() if self.chance(0.4) else self.blocks(self.rng.randrange(1, 4), depth + 1)
        return f"<{tag}>{heading}{inner}</{tag}>"

    def blocks(self, k: int, depth: int = 0) -> str:
        kinds = [(50, self.paragraph), (9, self.heading), (8, self.listing), (3, self.table), (3, self.code), (3, self.figure), (3, self.quote), (2, self.terms), (2, self.line)]
        kinds += [(12, lambda: self.group(depth))] if depth < 3 else []
        kinds += [(4, lambda: getattr(self, self.rng.choice(self.told(("ad", "sidebar", "share", "notice", "form"))))())]
        weights, makers = zip(*kinds, strict=True)
        return "".join(make() for make in self.rng.choices(makers, weights, k=k))

    def told(self, parts: tuple[str, ...]) -> tuple[str, ...]:
        """Of some parts those that their tags and words tell, where names say nothing."""
        return tuple(p for p in parts if p in ("form", "menu", "comments", "header")) if self.nameless else parts

    def page(self) -> str:
        rng = self.rng
        body = f"<h1>{MARK}{self.words(2, 10).capitalize()}</h1>" if self.chance(0.85) else ""
        headed = bool(body) and self.semantic and self.chance(0.3)  # the article has a header of its own
        if headed:
            body = f"<header>{body}{f'<p>{MARK}{self.words(3, 14)}</p>' if self.chance(0.3) else ''}</header>"
        body += (self.share() if self.chance(0.2) and self.told(("share",)) else "") + self.blocks(rng.randrange(1, 12)) + (self.comments() if self.chance(0.25) else "")
        if self.semantic:
            body = f"<article>{body}</article>" if self.chance(0.75) else body
            body = f"<main>{body}</main>" if "<article>" not in body[:9] or self.chance(0.3) else body
        elif self.chance(0.9):  # otherwise the article's blocks stand in the body
            body = self.box("content", "div", body)
            body = self.box("content", "div", body) if self.chance(0.3) else body
        before = [getattr(self, p)() for p in self.told(("header", "menu", "notice", "ad", "form", "sidebar")) if self.chance(0.5)]
        after = [getattr(self, p)() for p in self.told(("share", "comments", "sidebar", "ad", "form", "menu", "notice")) if self.chance(0.4)] + [self.footer()] * self.chance(0.85)
        return f"<html><head><title>{self.words(2, 6)}</title></head><body>{''.join(before)}{body}{''.join(after)}</body></html>"


def labelled_page(seed: int) -> str:
    """A page composed by rule; runs that are content begin with the mark."""
    return _Author(seed).page()


#: Labelled pages that the model is trained on.
TRAINING = 1200
_MODELS: dict[int, Model] = {}


def trained(pages: int = TRAINING) -> Model:
    if pages not in _MODELS:
        _MODELS[pages] = Model([labelled_page(s) for s in range(pages)])
    return _MODELS[pages]


def _extractor(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                some = batch.slice(first, 500)
                texts = [model.main_text(x.as_py()) for x in some["html"]]
                keep = [c for c in batch.schema.names if c != "html"]
                yield pa.RecordBatch.from_arrays([*(some[c] for c in keep), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*keep, "text", "n_chars"])

    return run


def extract_main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """Replaces ``html`` by ``text`` and ``n_chars``; the other columns stay."""
    pages = pages.drop("text", "n_chars")
    others = [f for f in pages.schema.fields if f.name != "html"]
    kind = StructType([*others, StructField("text", StringType()), StructField("n_chars", LongType())])
    return pages.mapInArrow(_extractor(model or trained()), kind)


def op1_dom_tree_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read_table(spark, sf_dir, "pages").select("page_id", "url", F.col("html")))
