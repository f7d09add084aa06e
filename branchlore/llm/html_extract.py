"""Main text of web pages by block rules in two passes.

A page is cut into blocks at block-level tags.  The first pass decides blocks by where they
stand (menus, forms, adverts, ... never belong to the text), by their share of linked
characters, their length and their share of stop words.  Short and doubtful blocks stay open.
The second pass gives an open block the label of its nearest decided neighbours.  Where a page
marks its article, only blocks inside can be text.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from branchlore.llm.common import kept_columns, map_rows, whole

SHORT, LONG = 70, 200  # characters
LINKED = 0.5  # share of a block's characters inside links from which it is no text
LINKED_SHORT = 0.2  # in a block that is not long
FEW_STOP_WORDS, MANY_STOP_WORDS = 0.1, 0.3

# Frequent function words of the languages that pages come in.
STOP_WORDS = frozenset(
    """
    a all an and are as at be but by for from had has have he his i in is it not of on or she so that the their they
    this to was we were which who will with you
    aber als am auch auf aus bei das dem den der des die ein eine einen er es für im in ist mit nach nicht oder sich
    sie sind und von war wie wird zu
    au aux avec ce dans de des du elle en est et il la le les mais ne on ou par pas plus pour que qui se son sur un une
    al como con del el era es esta este ha los más muy no nos para pero por si sin su sus un una y ya
    """.split()  # noqa: SIM905
)
# Element names of HTML by their part in a page.
RAW = frozenset(["script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noframes"])
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
BLOCK = frozenset(
    """
    address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section
    select summary table tbody td tfoot th thead tr ul
    """.split()  # noqa: SIM905
)
NEVER_TEXT = frozenset(
    """
    aside audio button canvas datalist dialog fieldset footer form head input label legend map menu meter nav object
    optgroup option progress select svg template video
    """.split()  # noqa: SIM905
)
PROSE = frozenset(["blockquote", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6", "p", "pre"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
BAD_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
BAD_NAMES = frozenset(
    """
    ad ads adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs byline comment commentlist
    comments consent cookie cookies copyright disqus footer gdpr login masthead menu modal nav navbar navigation
    newsletter notice notices pager pagination paywall popup promo promotion recommended related replies
    respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar
    widget widgets
    """.split()  # noqa: SIM905
)

# Names that say what stands beside an element or how it is set, not what it is.
MODIFIER = re.compile(r"(?:with|without|has|no)[-_].*|.*[-_](?:open|opened|closed|enabled|disabled)", re.IGNORECASE)

# Words that name such parts also inside longer names.
BAD_PARTS = re.compile("sidebar|advert|comment|cookie|newsletter|navbar|breadcrumb|footer|sponsor")

_TAG = re.compile(
    r"<(?:!--(?P<comment>)|[!?](?P<declaration>)|(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+))"
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_WORD = re.compile(r"\w+")


@dataclass
class Block:
    """A run of text between block-level tags, and where it stands."""

    inside: bool  # an article or the main part
    prose: bool  # a paragraph or the like, whose links are what it says
    heading: bool
    pieces: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return " ".join("".join(self.pieces).split())


def _no_text(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element can hold no part of the text, by its kind or role or because it is hidden."""
    if name in NEVER_TEXT or (name == "header" and not inside):
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        if key == "role" and value.lower() in BAD_ROLES:
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            return True
    return False


def _bad_name(name: str, attributes: str) -> bool:
    """Whether an element's class or id names a part that is no text."""
    if not attributes or name in ("html", "body", "main"):
        return False
    for key, value in _ATTRIBUTE.findall(attributes):
        if key.lower() in ("class", "id"):
            value = " ".join(v for v in value.strip("\"'").split() if not MODIFIER.fullmatch(v))
            if BAD_PARTS.search(value.lower()) or any(p.lower() in BAD_NAMES for p in _NAME_PART.findall(value)):
                return True
    return False


def _is_main(name: str, attributes: str) -> bool:
    return name in ("article", "main") or bool(attributes and re.search(r"role\s*=\s*[\"']?main\b|articleBody", attributes))


def blocks_of(page: str) -> list[Block]:
    """The page's blocks that have text, in order.

    What stands in an element that can hold no text is left out piece by piece, so a button or a
    hidden word takes nothing else of its paragraph along; only block-level elements part and
    describe blocks.  Class and id decide nothing about the outermost article or main part and
    what holds it.
    """
    open_: list[tuple[str, int, int, int, int, int, int]] = []  # name and what it adds: inside, never, link, heading, named, prose
    names: dict[str, int] = {}
    inside = never = link = heading = named = prose = 0
    blocks: list[Block] = []
    current: Block | None = None

    def say(text: str) -> None:
        nonlocal current
        if not text or never > 0 or named > 0:
            return
        if current is None:
            if text.isspace():
                return
            current = Block(inside > 0, prose > 0, heading > 0)
            blocks.append(current)
        text = html.unescape(text)
        current.pieces.append(text)
        if link:
            current.linked += len("".join(text.split()))

    at = 0
    while True:
        tag = _TAG.search(page, at)
        if tag is None:
            say(page[at:])
            break
        say(page[at : tag.start()])
        at = tag.end()
        if tag["comment"] is not None:
            end = page.find("-->", at - 2)
            at = len(page) if end < 0 else end + 3
            continue
        if tag["declaration"] is not None:
            end = page.find(">", at)
            at = len(page) if end < 0 else end + 1
            continue
        at += page.startswith(">", at)
        name, attributes = tag["name"].lower(), tag["attributes"]
        if name == "br":
            say(" ")
            continue
        if name in BLOCK:
            current = None
        if tag["end"]:
            if names.get(name):
                while True:
                    last, i, n, l, h, b, p = open_.pop()  # noqa: E741
                    names[last] -= 1
                    inside, never, link, heading, named, prose = inside - i, never - n, link - l, heading - h, named - b, prose - p
                    if last == name:
                        break
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>?", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        main = _is_main(name, attributes)
        outermost = main and (not inside or (name == "article" and not names.get("article")))
        adds = (
            int(main), int(_no_text(name, attributes, inside > 0)), int(name == "a"), int(name in HEADINGS),
            -named if outermost else int(_bad_name(name, attributes)), int(name in PROSE),
        )
        open_.append((name, *adds))
        names[name] = names.get(name, 0) + 1
        inside, never, link, heading, named, prose = (
            x + y for x, y in zip((inside, never, link, heading, named, prose), adds, strict=True)
        )
    return blocks


def _first_pass(block: Block, text: str) -> bool | None:
    """Text, no text, or open (None)."""
    signs = len(text.replace(" ", ""))
    linked = block.linked / signs if signs else 0.0
    if linked > LINKED:
        return None if block.inside and block.prose else False
    if linked > LINKED_SHORT and len(text) < LONG:
        return None if block.inside else False
    if block.heading or len(text) < SHORT:
        return None
    words = _WORD.findall(text.lower())
    stops = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    if stops >= MANY_STOP_WORDS or (len(text) >= LONG and stops >= FEW_STOP_WORDS):
        return True
    return None


def _second_pass(labels: list[bool | None], headings: list[bool]) -> list[bool]:
    """Open blocks take the label of the nearest decided block; equally near ones must agree to drop it."""
    n = len(labels)
    before, after = [(n, True)] * n, [(n, True)] * n
    last = None
    for i in range(n):
        if labels[i] is not None:
            last = (i, labels[i])
        if last:
            before[i] = (i - last[0], last[1])
    last = None
    for i in reversed(range(n)):
        if labels[i] is not None:
            last = (i, labels[i])
        if last:
            after[i] = (last[0] - i, last[1])
    out = []
    for label, b, a, heading in zip(labels, before, after, headings, strict=True):
        if label is None:
            if heading and a[0] < n:  # a heading belongs to what follows
                label = a[1]
            else:
                label = b[1] if b[0] < a[0] else a[1] if a[0] < b[0] else a[1] or b[1]
        out.append(label)
    return out


def main_text(page: str) -> str:
    """The page's main text: its blocks labelled text, joined by spaces."""
    blocks = [(b, t) for b in blocks_of(page) if (t := b.text())]
    if any(b.inside for b, _ in blocks):
        blocks = [(b, t) for b, t in blocks if b.inside]
    labels = _second_pass([_first_pass(b, t) for b, t in blocks], [b.heading for b, _ in blocks])
    return " ".join(t for (_, t), label in zip(blocks, labels, strict=True) if label)


def extract(pages: DataFrame) -> DataFrame:
    """Per page row ``page_id``, ``url``, ``text`` and ``n_chars``.

    A missing or empty page, and one without text, has the empty text; broken markup is read as
    far as it goes; repeated rows stay, each with its text; an empty table gives none; other
    columns are not looked at.
    """

    def run(page: bytes) -> tuple[str, int]:
        text = main_text(page.decode("utf-8", "replace"))
        text = text.encode("utf-8", "replace").decode()  # character references may name lone surrogates
        return text, len(text)

    rows = kept_columns(pages, "page_id", "url", "html").select("page_id", "url", whole("html").alias("html"))
    return map_rows(rows, run, "text string, n_chars long", "html").select("page_id", "url", "text", F.col("n_chars"))
