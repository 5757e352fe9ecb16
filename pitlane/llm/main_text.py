"""Main text of web pages by tree scoring.

Paragraphs pass points for length and commas to their ancestors, less with every level; a container's points are
discounted by the share of its text that is links. The best container and those of its siblings that belong to it
are kept, without what is marked as menu, header, footer, sidebar, notice, advert, form or reader comment.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pitlane.llm.common import map_column

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table
tbody td tfoot th thead tr ul""".split())
#: Elements whose text is never a page's text, and elements that are furniture wherever they stand.
NO_TEXT = frozenset("head script style noscript template svg math iframe object canvas audio video map select datalist textarea button title".split())
FURNITURE = frozenset("nav aside form footer menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
MARKS = frozenset("""ad ads advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs comment comments commentlist
consent cookie cookies copyright discussion disqus footer form gdpr header legal login masthead menu menubar modal nav navbar
navigation newsletter notice notices pager pagination popup promo promotion recommended related replies reply respond search
share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget widgets""".split())
#: Those of MARKS that go wherever they stand, whatever they hold: the readers' words.
COMMENTS = frozenset("comment comments commentlist discussion disqus replies reply respond".split())
#: Those of MARKS that may also name a part of an article: inside one, what they name goes if it is short or mostly links.
#: What any other of MARKS names goes there too, unless it holds most of the article.
DOUBTFUL = frozenset("banner copyright footer form header legal promotion related search social widget widgets".split())
#: The first heading of what readers wrote.
RESPONSES = re.compile(r"\W*(\d+|no|leave an?|join the|reader|user)?\s*(reader |user )?(comments?|responses?|replies|discussion)\b[\s\d():]*(so far|yet)?\W*$", re.I)
#: A start tag in the first set ends an open element of the second (up to an element that holds blocks).
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = frozenset("article aside body blockquote div dl fieldset figure footer form header html main nav ol section table td th tr ul".split())
PARAGRAPHS = frozenset("p pre blockquote td li dd".split())
#: Points that an article or main element has from the start; characters a link of a menu has on average at most.
BONUS, MENU_WORDS = 25, 20
CONTAINERS = frozenset("html article main section div body td blockquote center".split())
HEADINGS = frozenset("h1 h2 h3".split())
ALL_HEADINGS = HEADINGS | {"h4", "h5", "h6"}


class Page(HTMLParser):
    """The elements of a page in page order as parallel lists, and its texts with the element that holds each."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.label, self.hidden = ["html"], [-1], [""], [False]
        self.texts: list[tuple[int, str, int]] = []  # element, text, number of the run of inline content
        self.open, self.run = [0], 0
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body") and tag in self.tag[:1] + self.tag[1:4]:
            return
        if tag in BLOCK:
            self.run += 1
            if tag not in ("td", "th", "tr", "li", "dt", "dd", "option"):
                self._end({"p"})
        if tag in ENDS:
            self._end(ENDS[tag] | {"p"})
        if tag == "br":
            self.texts.append((self.open[-1], " ", self.run))
        if tag in VOID:
            return
        a = dict(attrs)
        self.tag.append(tag)
        self.parent.append(self.open[-1])
        self.label.append(" ".join((a.get("class") or "", a.get("id") or "")))
        style = (a.get("style") or "").replace(" ", "").lower()
        self.hidden.append("hidden" in a or a.get("aria-hidden") == "true" or "display:none" in style
                           or (a.get("role") or "").lower() in ROLES)
        self.open.append(len(self.tag) - 1)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.run += 1
        if tag in VOID:
            if tag == "br":
                self.texts.append((self.open[-1], " ", self.run))
            return
        for depth in range(len(self.open) - 1, 0, -1):
            open_tag = self.tag[self.open[depth]]
            if open_tag == tag:
                del self.open[depth:]
                return
            if open_tag in HOLDS and tag not in HOLDS:
                return

    def handle_data(self, data):
        self.texts.append((self.open[-1], data, self.run))

    def _end(self, tags: set[str]) -> None:
        """Close the innermost open element of these, unless one that holds blocks of its own lies above."""
        for depth in range(len(self.open) - 1, 0, -1):
            open_tag = self.tag[self.open[depth]]
            if open_tag in tags:
                del self.open[depth:]
                return
            if open_tag in HOLDS:
                return


def marked(label: str, marks: frozenset[str] = MARKS) -> bool:
    """Whether a class or id names furniture, taken word by word (siteNav, ad-box and cookie_notice alike)."""
    return any(w in marks for w in re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", label).lower()))


def _sums(page: Page, dropped: list[bool], linked: list[bool]) -> tuple[list[int], ...]:
    """Text and link characters below every element, text of its own, commas and anchors below."""
    n = len(page.tag)
    below, links, own, commas = [0] * n, [0] * n, [0] * n, [0] * n
    anchors = [int(t == "a") for t in page.tag]
    for i, text, _ in page.texts:
        if not dropped[i] and (size := len(text.strip())):
            own[i] += size
            below[i] += size
            commas[i] += text.count(",") + text.count("，") + text.count("、")
            links[i] += size * linked[i]
    for i in range(n - 1, 0, -1):
        for sums in (below, links, commas, anchors):
            sums[page.parent[i]] += sums[i]
    return below, links, own, commas, anchors


def _responses(page: Page) -> set[int]:
    """The sections and boxes whose first text is a heading of readers' comments."""
    found, first = set(), {}
    for i, text, _ in page.texts:
        if text.strip():
            at = i
            while at > 0 and page.tag[at] not in ALL_HEADINGS:
                at = page.parent[at]
            heading = at if at > 0 else 0
            up = i
            while up > 0 and up not in first:
                first[up] = (heading, text.strip())
                up = page.parent[up]
    for i, (heading, text) in first.items():
        if heading and heading != i and page.tag[i] in ("section", "div", "ol", "ul") and RESPONSES.match(text):
            above = page.parent[heading]
            while above > 0 and above != i:
                above = page.parent[above]
            if above == i:
                found.add(i)
    return found


def main_text(html: str) -> str:
    """The main text of a page; empty if it has none."""
    page = Page(html)
    n = len(page.tag)
    dropped, linked, article, doubtful, named_in = [False] * n, [False] * n, [0] * n, [], []
    responses = _responses(page)
    for i in range(1, n):
        up, tag = page.parent[i], page.tag[i]
        named = tag not in ("html", "body", "main") and page.label[i] != " " and marked(page.label[i])
        if named and article[up] and (tag in ALL_HEADINGS or not marked(page.label[i], COMMENTS)):
            named = False
            if tag not in ALL_HEADINGS:
                (doubtful if marked(page.label[i], DOUBTFUL) else named_in).append(i)
        furniture = tag in NO_TEXT or tag in FURNITURE or page.hidden[i] or named or i in responses or (tag == "header" and not article[up])
        dropped[i], linked[i] = dropped[up] or furniture, linked[up] or tag == "a"
        article[i] = article[up] or (i if tag in ("article", "main") else 0)
    below, links, own, commas, anchors = _sums(page, dropped, linked)
    # Inside an article a name that could be a part's own goes by what it names; others go unless they are the article.
    if doubtful or named_in:
        for i in doubtful:
            dropped[i] = dropped[i] or not (below[i] > 80 and links[i] < 0.25 * below[i])
        for i in named_in:
            dropped[i] = dropped[i] or below[i] <= 0.5 * below[article[i]]
        for i in range(1, n):
            dropped[i] = dropped[i] or dropped[page.parent[i]]
        below, links, own, commas, anchors = _sums(page, dropped, linked)
    # Lists and boxes that are nearly all links are menus, whatever they are called; inside an article only if the links are
    # a few words each, as references and paragraphs of links are the article's own.
    for i in range(1, n):
        menu = page.tag[i] in ("ul", "ol", "div", "table", "section", "p") and anchors[i] >= 3 and links[i] > 0.66 * below[i]
        if menu and article[page.parent[i]]:
            menu = page.tag[i] not in ("ol", "p") and links[i] > 0.9 * below[i] and links[i] <= MENU_WORDS * anchors[i]
        dropped[i] = dropped[i] or dropped[page.parent[i]] or menu
    points = [0.0] * n
    for i in range(n):
        size = below[i] if page.tag[i] in PARAGRAPHS else own[i] if page.tag[i] in CONTAINERS else 0
        if not size or dropped[i]:
            continue
        worth, up, level = 1 + commas[i] * (size / max(below[i], 1)) + min(size / 100, 3), page.parent[i], 1
        if page.tag[i] in CONTAINERS:
            points[i] += worth
        while up >= 0 and level <= 6:
            points[up] += worth / (1 if level == 1 else 2 if level == 2 else 3 * level)
            up, level = page.parent[up], level + 1
    density = [links[i] / below[i] if below[i] else 0.0 for i in range(n)]
    best, most = -1, 0.0
    for i in range(n):
        final = points[i] * (1 - density[i]) + BONUS * (page.tag[i] in ("article", "main") and below[i] > 0)
        if not dropped[i] and page.tag[i] not in ("p", "a", "b", "i", "span") and below[i] and final > most:
            best, most = i, final
    if best < 0:
        return ""
    if page.tag[best] == "article" and most > 0:
        # Readers' comments may be articles too: the first that is worth half as much as the best is the page's.
        best = next(i for i in range(1, n) if page.tag[i] == "article" and not dropped[i] and below[i] and 2 * (points[i] * (1 - density[i]) + BONUS) >= most)
        most = points[best] * (1 - density[best]) + BONUS
    inside = best
    while inside > 0 and page.tag[inside] not in ("article", "main"):
        inside = page.parent[inside]
    # An article's siblings are held against its points without the bonus, which they may not have.
    root = inside if inside > 0 else best
    most = points[root] * (1 - density[root]) if inside > 0 else most
    kept = {root}
    for i in range(1, n):
        if page.parent[i] == page.parent[root] and not dropped[i] and below[i]:
            long = below[i] > 80 and density[i] < 0.25 or not links[i]
            if points[i] * (1 - density[i]) >= max(1.0, 0.2 * most) or page.tag[i] in PARAGRAPHS and long or page.tag[i] in HEADINGS and not links[i]:
                kept.add(i)
    chosen = [False] * n
    for i in range(n):
        chosen[i] = i in kept or i > 0 and chosen[page.parent[i]]
    out: list[list[str]] = []
    last = None
    for i, text, run in page.texts:
        if chosen[i] and not dropped[i]:
            if run != last:
                out.append([])
                last = run
            out[-1].append(text)
    found = (" ".join("".join(parts).split()) for parts in out)
    return "\n".join(f for f in found if f)


def extract(pages: DataFrame, key: str | list[str] = "page_id", html: str = "html") -> DataFrame:
    """(key columns, text, n_chars) of every row of pages: the main text, its blocks joined by line ends, and its code
    points. Null or empty pages have an empty text. Pages are taken one by one and whole: repeated rows, null keys
    and further columns make no difference; an empty table gives none."""

    def make():
        def work(rows: list[str]) -> list[pa.Array]:
            texts = [main_text(h) for h in rows]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return work

    return map_column(pages, key, html, make, [("text", T.StringType()), ("n_chars", T.LongType())])
