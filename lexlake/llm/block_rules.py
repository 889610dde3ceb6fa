"""Main text of web pages by two passes of rules over their blocks.

A page becomes blocks: text between block-level tags, with the share of its letters inside links, its length, the share of
its words that are stop words, and where it stands. The first pass decides what it can: blocks inside navigation, page
headers, footers, sidebars, forms and what calls itself an advert, a notice or comments are boilerplate, as are blocks that
are mostly links; long blocks are text when their stop words are as dense as in prose. Blocks of an article that are not
long, and short blocks elsewhere, stay open. In the second pass an open block takes the label of the nearest decided
neighbour, a heading that of the next one; neighbours inside the same article come before those outside.

Where a page marks its article, and the article holds anything, only the article's blocks can be text. Languages written
without spaces, and those whose stop words are not known here, are judged by length and links alone.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from lexlake.llm.common import texts

# letters of a block: below the first it is short, from the second on long
SHORT, LONG = 70, 200
# share of letters inside links from which a block is a list of links
LINKS = 0.5
# share of stop words in prose, and the share in a whole page below which its language counts as unknown
PROSE, KNOWN = 0.12, 0.04

GOOD, BAD, OPEN = "good", "bad", "open"

# fixed values: frequent words of some languages
STOP_WORDS = frozenset(
    """
    the of and to a in is that it for on was with as be by at this from are or an not but have which
    de la le et les des en un une du que qui dans pour est au par sur pas plus avec il elle ce se
    der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an
    el los las del y en que por con una para se no su al lo como más pero sus
    o os e do da em um uma não com na no ao dos
    il di che per non si con del della sono le gli
    het een van dat op te zijn met voor niet aan
    """.split()
)

# fixed values: elements by what they do to the text
# content up to the end tag is no markup, and up to the page's end where there is none
_RAW = frozenset("script style noscript iframe noembed noframes xmp title textarea".split())
# left out with their content, inside a block too
_SKIPPED = frozenset("template svg object canvas audio video button select".split())
_BLOCKS = frozenset(
    """
    address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary
    table tbody td tfoot th thead tr ul
    """.split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BOILERPLATE = frozenset("nav footer aside dialog menu search datalist".split())
_BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
# an open element of the first kind ends where one of the second begins
_ENDED_BY = {
    "p": _BLOCKS - {"option", "optgroup"},
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "thead", "tfoot"}),
    "td": frozenset({"td", "th", "tr", "tbody", "thead", "tfoot"}),
    "th": frozenset({"td", "th", "tr", "tbody", "thead", "tfoot"}),
    "option": frozenset({"option", "optgroup"}),
}
# words of class and id attributes
_BOILERPLATE_NAMES = frozenset(
    """
    ad ads adv advert advertisement advertising banner sponsor sponsored sponsors promo promotion cookie cookies consent gdpr
    notice notices alert sidebar sidenav aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar
    comment comments respond replies disqus discussion related recommended recommendations share sharing social newsletter
    subscribe subscription signup login popup modal overlay widget widgets pagination pager skip legal copyright disclaimer
    """.split()
)
# an element with one of these is not what its name says: "has-sidebar"
_DENIALS = frozenset("has with no without".split())
_ARTICLE_NAMES = frozenset("article post entry story".split())
_COMMENT_TITLES = re.compile(
    r"(\d+\s+)?((reader|user)s?['’]?\s+)?(comments?|kommentare?|commentaires?|comentarios?|leserkommentare)(\s*\(\d+\))?:?", re.I
)

_TOKEN = re.compile(r"<(?:!--|[!?]|/?[A-Za-z])")
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']?[^\s>]*)))?")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    linked: int = 0
    # 1 to 6 for a heading, else 0
    heading: int = 0
    # number of the marked article it stands in, 0 outside
    article: int = 0
    boilerplate: bool = False
    # boilerplate by the name of a class or id alone, or inside a form
    by_name: bool = False
    words: int = 0
    stops: int = 0

    def count(self) -> None:
        found = [w.lower() for w in _WORD.findall(self.text)]
        self.words, self.stops = len(found), sum(w in STOP_WORDS for w in found)


@dataclass
class _Element:
    name: str
    article: int
    boilerplate: bool
    by_name: bool
    # a title of comments among its children makes the rest boilerplate
    commented: bool = False


@dataclass
class _Page:
    """Blocks of a page, collected tag by tag."""

    blocks: list[Block] = field(default_factory=list)
    stack: list[_Element] = field(default_factory=lambda: [_Element("", 0, False, False)])
    open_names: dict[str, int] = field(default_factory=dict)
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    in_link: bool = False
    breaks: int = 0
    articles: int = 0

    def text(self, raw: str) -> None:
        if raw:
            self.parts.append(raw)
            if not raw.isspace():
                self.breaks = 0
            if self.in_link:
                self.linked.append(raw)

    def line_break(self) -> None:
        self.breaks += 1
        if self.breaks > 1:
            self.end_block()
        else:
            self.parts.append("\n")

    def end_block(self) -> None:
        # references are decoded in the text as a whole, so that one is not cut by a comment
        text = " ".join(html.unescape("".join(self.parts)).split())
        if text:
            top = self.stack[-1]
            linked = len(" ".join(html.unescape("".join(self.linked)).split()))
            heading = next((int(e.name[1]) for e in self.stack[-2:] if e.name in _HEADINGS), 0)
            block = Block(text, linked, heading, top.article, top.boilerplate or top.commented, top.by_name and not top.boilerplate)
            if heading and _COMMENT_TITLES.fullmatch(text):
                block.boilerplate = True
                for parent in reversed(self.stack):
                    if parent.name not in _HEADINGS:
                        parent.commented = parent.name not in ("", "html", "body", "main")
                        break
            self.blocks.append(block)
        self.parts, self.linked, self.breaks = [], [], 0

    def start(self, name: str, attributes: dict[str, str]) -> None:
        if name == "br":
            return self.line_break()
        if name == "a":
            self.in_link = True
            return None
        if name not in _BLOCKS and name not in _BOILERPLATE:
            return None
        self.end_block()
        if name in _VOID:
            return None
        while len(self.stack) > 1 and name in _ENDED_BY.get(self.stack[-1].name, ()):
            self.pop()
        top = self.stack[-1]
        roles = set(attributes.get("role", "").lower().split())
        names = {p.lower() for key in ("class", "id") for p in _NAME_PARTS.findall(attributes.get(key, ""))}
        article = top.article
        if not article and (name in ("article", "main") or "main" in roles or "article" in roles or attributes.get("itemprop") == "articleBody"):
            self.articles += 1
            article = self.articles
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true"
        page_header = name == "header" and not top.article
        boilerplate = name in _BOILERPLATE or bool(roles & _BOILERPLATE_ROLES) or page_header or hidden
        by_name = name == "form"
        if name not in ("html", "body", "main") and (name != "article" or "comment" in names) and not names & _DENIALS:
            of_page = "header" in names and not article and not names & _ARTICLE_NAMES
            by_name = by_name or of_page or bool(names & _BOILERPLATE_NAMES)
        self.stack.append(_Element(name, article, top.boilerplate or top.commented or boilerplate, top.by_name or by_name))
        self.open_names[name] = self.open_names.get(name, 0) + 1
        return None

    def end(self, name: str) -> None:
        if name == "a":
            self.in_link = False
        elif name == "br":
            self.line_break()
        elif name in _BLOCKS or name in _BOILERPLATE:
            self.end_block()
            if self.open_names.get(name):
                while self.stack[-1].name != name:
                    self.pop()
                self.pop()

    def pop(self) -> None:
        self.open_names[self.stack.pop().name] -= 1
        self.in_link = False


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order. Tags and comments that the page's end cuts off are dropped, what they opened ends."""
    out, at, end = _Page(), 0, len(page)
    unclosed: set[str] = set()
    while at < end:
        found = _TOKEN.search(page, at)
        if not found:
            out.text(page[at:])
            break
        out.text(page[at : found.start()])
        opened = found[0]
        if opened == "<!--":
            # also "<!-->" and "<!--->" are whole comments
            closed = page.find("-->", found.start() + 2)
            at = end if closed < 0 else closed + 3
        elif opened in ("<!", "<?"):
            closed = page.find(">", found.end())
            at = end if closed < 0 else closed + 1
        else:
            name = _NAME.match(page, found.end() - 1)
            tag = name[0].lower()
            attributes, at = _attributes(page, name.end())
            if at < 0:
                break
            if opened.startswith("</"):
                out.end(tag)
            elif tag in _RAW:
                at = _behind(page, tag, at) or end
            elif tag in _SKIPPED:
                behind = None if tag in unclosed or page[at - 2] == "/" else _behind(page, tag, at)
                if behind is None and page[at - 2] != "/":
                    unclosed.add(tag)
                at = behind or at
            else:
                out.start(tag, attributes)
    out.end_block()
    return out.blocks


def _attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes of a tag and the place behind it, -1 where the page ends inside."""
    found: dict[str, str] = {}
    while True:
        match = _ATTRIBUTE.match(page, at)
        if not match:
            closed = page.find(">", at)
            return found, closed + 1 if closed >= 0 else -1
        if match[4] and match[4][0] in "\"'":
            # the quote is never closed
            return found, -1
        value = next((v for v in match.groups()[1:] if v is not None), "")
        found.setdefault(match[1].lower(), html.unescape(value) if "&" in value else value)
        at = match.end()


def _behind(page: str, tag: str, at: int) -> int | None:
    """The place behind the next end tag of that name; None if there is none."""
    closing = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
    return closing.end() if closing else None


def _first_pass(found: list[Block], by_name: bool) -> list[str]:
    """Labels that a block earns by itself."""
    for block in found:
        block.count()
    usable = [b for b in found if not (b.boilerplate or (by_name and b.by_name))]
    words = sum(b.words for b in usable)
    known = words > 0 and sum(b.stops for b in usable) >= KNOWN * words
    marked = any(b.article for b in usable if b.linked < LINKS * len(b.text))
    labels = []
    for b in found:
        prose = not known or b.stops >= PROSE * max(b.words, 1)
        if b.boilerplate or (by_name and b.by_name) or b.linked >= LINKS * len(b.text) or (marked and not b.article):
            labels.append(BAD)
        elif len(b.text) < SHORT or b.heading:
            labels.append(OPEN)
        elif prose or b.article:
            labels.append(GOOD)
        else:
            labels.append(BAD if len(b.text) >= LONG else OPEN)
    return labels


def _second_pass(found: list[Block], labels: list[str]) -> list[bool]:
    """Whether each block is text; open ones inherit."""
    n = len(found)
    before, after = _nearest(found, labels, range(n)), _nearest(found, labels, range(n - 1, -1, -1))
    kept = []
    for i, block in enumerate(found):
        if labels[i] != OPEN:
            kept.append(labels[i] == GOOD)
            continue
        left, right = before[i], after[i]
        near = [j for j in (left, right) if j is not None and found[j].article == block.article]
        if not near and block.article:
            # nothing is decided in its article
            kept.append(True)
            continue
        if block.heading and right in near:
            near = [right]
        near = near or [j for j in (left, right) if j is not None]
        # the nearer one; of two as near, the one that is text
        near.sort(key=lambda j: (abs(j - i), labels[j] != GOOD))
        kept.append(bool(near) and labels[near[0]] == GOOD)
    return kept


def _nearest(found: list[Block], labels: list[str], order: range) -> list[int | None]:
    """Per block the last decided one passed on the way: of its own article if there is one, else of any."""
    out: list[int | None] = [None] * len(found)
    last: int | None = None
    own: dict[int, int] = {}
    for i in order:
        article = found[i].article
        out[i] = own.get(article, last)
        # boilerplate marked as such stands for itself and tells nothing about the article it interrupts
        if labels[i] == GOOD or (labels[i] == BAD and not (article and (found[i].boilerplate or found[i].by_name))):
            last = i
            own[article] = i
    return out


def main_text(page: str | None) -> str:
    """The article of a page: its blocks joined by empty lines; empty for a page without any, and for NULL."""
    found = blocks(page or "")
    kept = _second_pass(found, _first_pass(found, True))
    if not any(kept) and any(b.by_name and b.heading == 1 for b in found):
        # names that would take a page's title and leave nothing are not believed
        kept = _second_pass(found, _first_pass(found, False))
    return "\n\n".join(b.text for b, keep in zip(found, kept, strict=True) if keep)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [main_text(page) for page in texts(batch, "html")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) per row of ``pages`` (page_id, url, html), from the whole page.

    NULL and empty pages, and pages without an article, have an empty text. Rows are taken one by one: repeated rows give
    repeated rows, NULL ids and addresses stay, an empty table gives none, other columns are not looked at.
    """
    types = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    schema = f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long"
    return pages.select("page_id", "url", "html").mapInArrow(_extracted, schema)
