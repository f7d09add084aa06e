from __future__ import annotations

import html
import random
import re
from html.parser import HTMLParser

import pytest

from branchlore.llm.html_extract import extract, main_text

PROSE = "The of and to in that is was for it with as his on be at by this had not are but from or have an they. " * 3
PROSE = PROSE.strip()


def test_test_pages_equal_the_article_cut_out_plainly(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    raw = {r.page_id: r.html for r in pages.collect()}
    got = extract(pages).collect()
    assert len(got) == len(raw)
    for row in got:
        article = re.search(r"<article>(.*)</article>", raw[row.page_id], re.DOTALL)[1]
        article = re.sub(r"</?(?:p|h1|br)>", " ", article)
        want = " ".join(html.unescape(re.sub(r"</?[a-z][^>]*>", "", article)).split())
        assert row.text == want and row.n_chars == len(want)


@pytest.mark.parametrize(
    "page, want",
    [
        ("", ""),
        (f"<p>{PROSE}</p>", PROSE),
        (f"<body><header>The site of this and that</header><div id=main>{PROSE}<p>Short end.</div><footer>x</footer>", PROSE + " Short end."),
        (f"<h1>Title</h1><p>{PROSE}<div class='user-comments'><p>{PROSE}</p></div>", "Title " + PROSE),
        (f"<main><h2>A</h2><p>a&amp;amp;b &lt;i&gt; <b>bo</b>ld\n\t x<aside>{PROSE}</aside></main><p>{PROSE}", "A a&amp;b <i> bold x"),
        (f"<article><p>{PROSE}<form>name <input> the of and</form><!-- <p>no --><p>end<script>var t='</p>the'</script></article>", PROSE + " end"),
        (f"<div><a href=x>{PROSE}</a></div><p>{PROSE}", PROSE),
        (f'<div role="navigation">{PROSE}</div><div hidden>{PROSE}</div><div class="cookieNotice">{PROSE}</div>{PROSE}', PROSE),
        (f"<p title='a > b'>{PROSE}</p", PROSE),
        (f'<p id="leftSidebar2">{PROSE}</p><div class="usercomments">{PROSE}</div><p class="lead adverb">{PROSE}', PROSE),
        (f"<p>1 < 2 and {PROSE}<!-- open {PROSE}", f"1 < 2 and {PROSE}"),
        ("<article><p>One short line.</p></article>", "One short line."),
        (f"<article><h1>T</h1><p>{PROSE}</p><div class=ad>{PROSE}</div><p>Last.</p></article>", f"T {PROSE} Last."),
    ],
)
def test_rules(page, want):
    assert main_text(page) == want


def test_long_and_broken_pages_end_soon():
    assert main_text("<b>" * 200_000 + "</i>" * 1000 + "x") == "x"
    assert main_text("<" * 300_000 + "p") == "<" * 299_999  # the last is an open tag
    assert main_text('<a href="' * 2000 + PROSE) is not None


def test_odd_rows(spark):
    rows = [(None, None, None, "x"), (1, "u", "", "x"), (2, "u", f"<p>{PROSE}&#xD800;", "y"), (2, "u", f"<p>{PROSE}&#xD800;", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in extract(pages).collect()), key=str)
    tail = PROSE + "�"
    assert got == sorted([(None, None, "", 0), (1, "u", "", 0), *[(2, "u", tail, len(tail))] * 2], key=str)
    assert extract(pages.where("false")).collect() == []


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<div class='content with-sidebar'><article><p>{PROSE}</article></div><div class=sidebar>{PROSE}</div>", PROSE),
        (f"<div class=comments-layout><div id=sidebar-left>x y</div><article><p>{PROSE}</article></div><p>{PROSE}", PROSE),
        (f"<article class='post comments-open'><p>{PROSE}<div class=comments>{PROSE}</div></article>", PROSE),
        (f"<article><p>{PROSE}</p><article class=comment>{PROSE}</article></article>", PROSE),
        (f"<main><div class='has-sidebar no-comments footer-closed'><p>{PROSE}</div></main>", PROSE),
        (f"<div class='with-sidebar'><p>{PROSE}</div><div class=ad>{PROSE}</div>", PROSE),
        (f"<nav><article>{PROSE}</article></nav><p>{PROSE}", PROSE),
        (f"<article><p>{PROSE}</p><p>See <a href=x>the linked page</a> of that and this, here.</p></article>", f"{PROSE} See the linked page of that and this, here."),
        (f"<p>{PROSE}</p><p><a href=x>the linked page</a> is here and there.</p>", PROSE),
    ],
)
def test_names_and_links_around_an_article(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize(
    "inside, want",
    [
        ("<p><button>Share</button> Real words.</p>", "Real words."),
        ("<p><span hidden>x</span> Real words.</p>", "Real words."),
        ("<p><span class='share-count'>3</span> Real words.</p>", "Real words."),
        ("<p>Real <span style='display:none'>HIDDEN</span> words.</p>", "Real words."),
        ("<p>Real<span class='ad'>ADVERT</span> words.</p>", "Real words."),
        ("<p>Real <svg><text>x</text></svg>words<label>y<input>z</label>.</p>", "Real words."),
        ("<p><a href=x>Real linked words.</a></p>", "Real linked words."),
        ("<p><span aria-hidden=true><b>x<i>y</b></span>Real words.</p>", "Real words."),
        ("<ul class=related><li><a href=x>one</a></li></ul>", ""),
        ("<ul><li><a href=x>one</a></li><li><a href=y>two</a></li></ul>", ""),
    ],
)
def test_inline_elements_decide_only_their_own_words(inside, want):
    page = f"<nav>menu</nav><article><p>{PROSE}</p>{inside}<p>{PROSE}</p></article>"
    assert main_text(page) == " ".join(t for t in (PROSE, want, PROSE) if t)


class Walker(HTMLParser):
    """The article's visible text by walking the whole tree: every piece asks all elements around it."""

    VISIBLE = {"em", "b", "a", "span", "i", "code"}

    def __init__(self):
        super().__init__()
        self.open, self.blocks = [], []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            return self.handle_data(" ")
        self.open.append((tag, dict(attrs)))
        if tag not in self.VISIBLE | {"button", "svg", "label"}:
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.open.pop()
        if tag not in self.VISIBLE | {"button", "svg", "label"}:
            self.blocks.append("")

    def handle_data(self, data):
        tags = [t for t, _ in self.open]
        hidden = any(
            t in ("button", "svg", "label", "aside", "form") or "hidden" in a or "none" in a.get("style", "") or a.get("class") in ("ad", "share-count")
            for t, a in self.open
        )
        if "article" in tags and not hidden:
            self.blocks[-1] += data

    def text(self) -> str:
        return " ".join(" ".join(b.split()) for b in self.blocks if b.strip())


def random_inline(rng: random.Random, depth: int) -> str:
    out = []
    for _ in range(rng.randint(1, 4)):
        out.append(rng.choice(["word", " and the ", "of it", " ", "\n", "é&amp;x", "it was "]))
        if depth and rng.random() < 0.6:
            tag, attrs = rng.choice(
                [("em", ""), ("b", ""), ("a", " href=x"), ("span", " class=lead"), ("span", " hidden"), ("span", " style='display:none'"),
                 ("span", " class=ad"), ("i", " class='share-count'"), ("button", ""), ("svg", ""), ("label", ""), ("code", "")]
            )
            out.append(f"<{tag}{attrs}>{random_inline(rng, depth - 1)}</{tag}>")
        if rng.random() < 0.1:
            out.append("<br>")
    return "".join(out)


@pytest.mark.parametrize("seed", range(40))
def test_random_inline_elements_equal_the_walked_tree(seed):
    rng = random.Random(seed)
    parts = [f"<p>{PROSE}</p>"]
    for _ in range(12):
        parts.append(f"<p>{random_inline(rng, 3)}</p>" if rng.random() < 0.8 else f"<aside>{random_inline(rng, 2)}</aside>")
        parts.append(f"<p>{PROSE}</p>")
    page = f"<body><nav>menu</nav><article>{''.join(parts)}</article><footer>end</footer></body>"
    walker = Walker()
    walker.feed(page)
    assert main_text(page) == walker.text()


def test_pages_without_an_article_keep_prose_and_drop_the_rest():
    """Share of paragraphs told rightly on pages that mark nothing."""
    rng = random.Random(11)
    words = ["the", "of", "and", "to", "in", "house", "river", "walked", "green", "that", "was", "for", "stone", "it", "with"]
    right = total = 0
    for _ in range(60):
        parts = []
        for n in range(12):
            if rng.random() < 0.6:
                parts.append((f"good{n} " + " ".join(rng.choices(words, k=rng.randint(25, 80))), True, "p"))
            else:
                links = " ".join(f"<a href=x>bad{n} {rng.choice(words)}</a>" for _ in range(rng.randint(2, 6)))
                parts.append((links, False, "div"))
        text = main_text("<body>" + "".join(f"<{tag}>{t}</{tag}>" for t, _, tag in parts) + "</body>")
        for n, (_, good, _) in enumerate(parts):
            total += 1
            right += (f"good{n} " in text) if good else (f"bad{n} " not in text)
    assert right / total > 0.98
