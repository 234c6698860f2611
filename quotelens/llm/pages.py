"""Parse web pages into trees of block elements, and the pages the extractor is trained on."""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

# HTML element names by what they do to the tree.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title".split())
#: Elements within a paragraph that are blocks of their own.
WITHIN = frozenset("button select object noscript template iframe".split())
#: Their inner elements are inline, whatever their names, up to one that only HTML has.
FOREIGN = frozenset(("svg", "math"))
BREAKS = frozenset(
    "address article aside blockquote body center dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hr html li main menu nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var".split()
)
#: An opening tag closes an open element of these names, up to the nearest element that confines it.
CLOSES = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "tbody": ("thead", "tbody", "tr", "td", "th"),
    "tfoot": ("thead", "tbody", "tr", "td", "th"),
    "body": ("head",),
}
CONFINES = frozenset("ul ol dl table body html article section div main aside nav header footer form td th".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attributes>[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>"
    r"|<(?P<broken>[a-zA-Z][^\s/>]*)(?P<rest>[^>]*)(?:>|\Z)",
    re.S,
)
NAMED = re.compile(r"\b(class|id|role|data-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


@dataclass
class Page:
    """Block elements in page order, each after its parent, and runs of text that lie in them."""

    tags: list[str] = field(default_factory=lambda: ["html"])
    parents: list[int] = field(default_factory=lambda: [-1])
    depths: list[int] = field(default_factory=lambda: [0])
    names: list[str] = field(default_factory=lambda: [""])
    labels: list[int] = field(default_factory=lambda: [0])
    linked: list[int] = field(default_factory=lambda: [0])
    blocks: list[tuple[int, str]] = field(default_factory=list)


class _Open:
    """The open elements, outermost first, and where those of each name stand.

    Whether a name is open, which element of some names is the innermost, and what
    would confine it are each told without going through the others, so a page takes
    time in proportion to its length however deep it is.
    """

    def __init__(self):
        self.stack: list[tuple[str, int]] = [("html", 0)]
        self.places: dict[str, list[int]] = {}

    def push(self, name: str, node: int) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, node))

    def node(self) -> int:
        return self.stack[-1][1]

    def has(self, name: str) -> bool:
        return bool(self.places.get(name))

    def _innermost(self, names: Iterable[str]) -> int:
        return max((places[-1] for n in names if (places := self.places.get(n))), default=0)

    def close(self, names: tuple[str, ...], confines: frozenset[str]) -> None:
        """End the innermost of ``names``, and all in it, unless something else confines it.

        Several names are ended again and again, as long as there is one.
        """
        others = confines.difference(names)
        while (at := self._innermost(names)) and at > self._innermost(others):
            for name, _ in self.stack[at:]:
                self.places[name].pop()
            del self.stack[at:]
            if len(names) == 1:
                return


def parse(source: str) -> Page:
    """The tree of a page, however it is marked up.

    Inline elements are part of their block. A paragraph ends where a block
    begins; ends without a beginning count for nothing; what is left open ends
    with the page. Scripts, styles, text areas, titles and comments are left out.
    White space in a block becomes one space; a line break begins a new run.
    """
    page = Page()
    open_ = _Open()
    run: list[str] = []
    links = at = 0
    foreign = False
    while True:
        tag = TAG.search(source, at)
        text = source[at : tag.start()] if tag else source[at:]
        if text:
            run.append(text)
            if links and not text.isspace():
                page.linked[open_.node()] += len(text)
        if tag is None:
            break
        at = tag.end()
        name = (tag["start"] or tag["broken"] or tag["end"] or "").lower()
        if not name:
            continue
        if name == "a":
            links = int(tag["end"] is None)
        if name in FOREIGN or name in BREAKS or (foreign and tag["end"] and open_.has(name)):
            foreign = name in FOREIGN and tag["end"] is None and not tag[0].endswith("/>")
        if name in INLINE or name in FOREIGN or (foreign and name not in RAW):
            continue
        if name == "br" or tag["end"] is None or open_.has(name):
            _flush(page, open_.node(), run)
            links = 0
        if tag["end"] is not None:
            if name != "html":
                open_.close((name,), frozenset(("table",)) if name in ("td", "th", "tr", "li") else frozenset())
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        if name in VOID:
            continue
        if name not in WITHIN:
            open_.close(("p",), CONFINES | WITHIN)
        if name in CLOSES:
            open_.close(CLOSES[name], CONFINES - {"td", "th"} if name in ("td", "th", "tr", "tbody", "tfoot") else CONFINES)
        attributes = tag["attributes"] if tag["start"] else tag["rest"]
        found = {k.lower(): a or b or c for k, a, b, c in NAMED.findall(attributes)} if "=" in attributes else {}
        if name == "html":
            page.labels[0] = int(found.get("data-label", 0))
            continue
        parent = open_.node()
        page.tags.append(name)
        page.parents.append(parent)
        page.depths.append(page.depths[parent] + 1)
        page.names.append(" ".join(found.get(k, "") for k in ("class", "id", "role")).lower())
        page.labels.append(int(found["data-label"]) if "data-label" in found else page.labels[parent])
        page.linked.append(0)
        open_.push(name, len(page.tags) - 1)
    _flush(page, open_.node(), run)
    return page


def _flush(page: Page, node: int, run: list[str]) -> None:
    if run:
        text = " ".join(html.unescape("".join(run)).split())
        run.clear()
        if text:
            page.blocks.append((node, text))


# --- labelled pages -------------------------------------------------------------

SYLLABLES = "an ber cho da el fi gen ha in ka lo mi nor os pra qui ra sten tu ul va wen".split()


class _Writer:
    """Writes a page of a random layout; ``data-label`` marks where content begins and ends."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        # Some pages are written without full stops.
        self.stops = self.r.choice(("..!?", "..!?", "..!?", "....", ("", "", "."), ("", " |", "!!", "***")))

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.choice((1, 1, 2, 3))))

    def sentence(self, low: int = 3, high: int = 18) -> str:
        words = [self.word() for _ in range(self.r.randint(low, high))]
        return " ".join(words).capitalize() + self.r.choice(self.stops)

    def prose(self, sentences: int) -> str:
        found = " ".join(self.sentence() for _ in range(sentences))
        if self.r.random() < 0.3:
            found += f' <a href="/{self.word()}">{self.word()}</a> {self.word()}.'
        return found if self.r.random() < 0.8 else f"<b>{self.sentence()}</b> {found}"

    def box(self, tags: str, names: str, inner: str, label: str = "") -> str:
        tag = self.r.choice(tags.split())
        name = self.r.choice(names.split("|"))
        by = self.r.choice(("class", "class", "id"))
        shown = f' {by}="{name}"' if name else ""
        return f"<{tag}{shown}{label}>{inner}</{tag}>"

    def links(self, n: int) -> str:
        items = [f'<a href="/{self.word()}">{self.word()} {self.word() if self.r.random() < 0.4 else ""}</a>' for _ in range(n)]
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return self.r.choice((" | ", " ", "<br>")).join(items)

    def boilerplate(self) -> dict[str, str]:
        r = self.r
        teaser = f"<h3>{self.sentence(2, 4)}</h3><p>{self.prose(r.randint(1, 3))}</p>"
        comment = "".join(
            self.box("div li article p", "comment|comment-body|reply|", f"<p>{self.word()} {self.prose(r.randint(1, 5))}</p>")
            for _ in range(r.randint(1, 4))
        )
        ask = f"<label>{self.word()}</label><input name=q><textarea></textarea><button>{self.word()}</button>"
        return {
            "menu": self.box("nav nav div ul", "menu|nav|main-nav|navbar|", self.links(r.randint(3, 9))),
            "header": self.box("header header div", "header|masthead|top|site-header", f"<p>{self.sentence(2, 5)}</p>" + self.links(r.randint(0, 4))),
            "advert": self.box("div div aside p", "ad|ads|advert|advertisement|sponsored|promo|banner-ad", self.sentence(3, 14)),
            "notice": self.box("div p section aside", "notice|cookie-notice|consent|alert|cookie-banner|gdpr", self.prose(r.randint(1, 2)) + ask * (r.random() < 0.3)),
            "sidebar": self.box("aside aside div section", "sidebar|side|widget|related|recommended|", teaser + self.links(r.randint(2, 6))) if r.random() < 0.7 else self.box("aside", "|sidebar", self.prose(r.randint(1, 4))),
            "form": self.box("form", "search|newsletter|subscribe|contact|", f"<p>{self.sentence(2, 8)}</p>{ask}"),
            "comments": self.box("section div ol", "comments|comment-list|discussion|replies|disqus", f"<h3>{self.word()}</h3>{comment}"),
            "share": self.box("div ul p", "share|social|tags|post-meta|byline", self.links(r.randint(2, 4))),
            "crumbs": self.box("nav div p", "breadcrumb|breadcrumbs", self.links(r.randint(2, 3))),
            "footer": self.box("footer footer div", "footer|site-footer|copyright|", f"&copy; {self.word()} &middot; {self.sentence(3, 12)}" + self.links(r.randint(0, 4))),
        }

    def article(self) -> str:
        r, parts = self.r, []
        if r.random() < 0.85:
            parts.append(f"<h1>{self.sentence(2, 9)}</h1>")
        for _ in range(r.choice((1, 2, 4, 8, 14))):
            kind = r.random()
            if kind < 0.72:
                parts.append(f"<p>{self.prose(r.choice((1, 1, 2, 4, 7)))}</p>")
            elif kind < 0.82:
                parts.append(f"<p><b>{self.sentence(2, 9)}<br>")
            elif kind < 0.88:
                parts.append(f"<h2>{self.sentence(1, 5)}</h2>")
            elif kind < 0.92:
                parts.append("<ul>" + "".join(f"<li>{self.sentence()}" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.96:
                parts.append(f"<blockquote>{self.prose(2)}</blockquote>")
            else:
                rows = "".join(f"<tr><td>{self.word()}<td>{self.sentence(1, 4)}" for _ in range(3))
                parts.append(f"<table>{rows}</table>")
        boxes = self.boilerplate()
        for name in ("advert", "share", "sidebar", "form", "notice"):
            if r.random() < 0.08:
                inside = re.sub(r"^<(\w+)", r'<\1 data-label="0"', boxes[name])
                parts.insert(r.randint(min(1, len(parts)), len(parts)), inside)
        return "".join(parts)

    def page(self) -> str:
        r, boxes, label = self.r, self.boilerplate(), ' data-label="1"'
        if r.random() < 0.05:
            bare = self.article() if r.random() < 0.6 else self.prose(r.randint(1, 4))
            return f"<{r.choice(('html', 'body'))}{label}>{bare}"
        content = self.box("article article main div div section td", "||||post|article|entry-content|content|story|main|post-body|text", self.article(), label)
        if content.startswith("<td"):
            content = f"<table><tr>{content}</tr></table>"
        if r.random() < 0.25:
            content = self.box("main div section", "main|content|wrapper|container||page", content)
        shown = {name: box for name, box in boxes.items() if r.random() < (0.75 if name in ("menu", "footer") else 0.4)}
        above = [shown.pop(x) for x in ("notice", "header", "menu", "crumbs", "advert") if x in shown and r.random() < 0.8]
        body = "".join(above) + content + "".join(shown.values())
        if r.random() < 0.3:
            body = self.box("div", "wrapper|page|container|site|", body)
        head = f"<head><title>{self.sentence()}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        return f"<!DOCTYPE html><html>{head}<body>{body}" + "</body></html>" * (r.random() < 0.9)


def labelled_pages(n: int = 400, seed: int = 7) -> list[str]:
    """``n`` pages of known layout, to train on: elements under ``data-label="1"`` are content."""
    return [_Writer(seed * 100_003 + i).page() for i in range(n)]
