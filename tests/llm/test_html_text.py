"""Main text of pages with known content."""

import math
import random

import pytest

from mathgrade.llm import html_text

LONG = "A paragraph with a fair amount of plain text in it, as articles have. "
PAGES = {
    "article": (f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href=x>Home</a></ul></nav><div class='ad'>Buy {LONG}</div>"
                f"<article><h1>Head</h1><p><b>{LONG}<br><p>Two &amp; three&nbsp;&#233;</p><script>var a='<p>no</p>'</script></article><footer>&copy; me</footer>",
                f"Head {LONG.strip()} Two & three é"),
    "no article": (f"<body><header>Site name</header><div id=main-content><h2>Title</h2><p>{LONG}{LONG}</p><p>{LONG}</p><p>{LONG}{LONG}</p></div>"
                   f"<aside><p>{LONG}</p></aside><form>Name <input> {LONG}</form><div class=cookieNotice>{LONG}</div>"
                   f"<section id=comments><p>{LONG}</p></section></body>", f"Title {LONG}{LONG}{LONG}{LONG}{LONG}".strip()),
    "article header": (f"<article><header><h1>Head</h1></header><p>{LONG}</p><div class='share'>Share this</div><footer>Tags</footer></article>", f"Head {LONG.strip()}"),
    "white space": ("<main><p> a \n\t b </p>\n<p>c<b>d</b> e</p></main>", "a b cd e"),
    "plain": ("just text", "just text"),
    "empty": ("", ""),
    "null": (None, ""),
    "only menu": ("<nav><a>x</a><a>y</a></nav>", ""),
    "broken": ("<div><p>one<div>two</p></span>three &am", "one two three &am"),
    "unclosed nav": ("<div><nav><li>menu<li>more</div><p>text that stays here</p>", "text that stays here"),
    "inline advert": (f"<article><p>{LONG}<span class=advert>buy this</span> and <span hidden>not seen</span>more</p></article>", f"{LONG}and more"),
    "no advert": (f"<article><p class=ad-hoc>An ad hoc remark.</p><section id=related-work><p>{LONG}</p></section></article>", f"An ad hoc remark. {LONG.strip()}"),
    "placed": (f"<div class='sidebar-left x'><p>{LONG}</p></div><div>{LONG}</div>", LONG.strip()),
    "closing lines": (f"<div><h2>Head</h2><p>{LONG}</p><p>{LONG}</p><p>Short end.</p><p>Bye.</p></div>", f"Head {LONG}{LONG}Short end. Bye."),
    "hidden": ("<p hidden>no</p><p>yes it is</p>", "yes it is"),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    html, text = PAGES[name]
    assert html_text.main_text(html) == text


def test_link_lists_without_containers_go():
    links = "".join(f"<div><a href=/{i}>Section {i}</a></div>" for i in range(12))
    body = "".join(f"<div>{LONG}{LONG}</div>" for _ in range(6))
    assert html_text.main_text(links + body + links) == " ".join([(LONG + LONG).strip()] * 6)


def test_ratios_decide_inside_articles():
    """Runs of lines of little text and many tags at an article's ends go; short lines of text stay, however long others are."""
    body = f"<h1>Head</h1><p>{LONG}</p><p>Short.</p><p>{LONG * 400}</p><p>No.</p><p>{LONG}</p><table><tr><td>1<td>2</table><p>{LONG}</p><p>End.</p>"
    want = " ".join(["Head", LONG.strip(), "Short.", (LONG * 400).strip(), "No.", LONG.strip(), "1", "2", LONG.strip(), "End."])
    assert html_text.main_text(f"<article>{body}</article>") == want
    icons = f"<div>{'<i></i>' * 20}ok</div>" * 6
    got = html_text.main_text(f"<article>{icons}{body}{icons}</article>")
    assert got == want
    assert html_text.main_text(f"<main><p>{LONG}</p><div><a href=x>Link</a></div><p>{LONG}</p></main>") == " ".join([LONG.strip()] * 2)


def plain_select(lines):
    """Ratios, smoothing, threshold and regions, spelled out."""
    article = any(inside and not outside for _, _, _, outside, inside in lines)
    ratio = []
    for text, tags, links, outside, inside in lines:
        w = 0.02 if outside else 0.05 if article and not inside else 1.0
        ratio.append(w * math.log(1 + max(len(text) - links, 0) / max(tags, 1)))
    smooth = []
    for i in range(len(lines)):
        near = [(math.exp(-k * k / 2), ratio[i + k]) for k in range(-2, 3) if 0 <= i + k < len(lines)]
        smooth.append(sum(g * r for g, r in near) / sum(g for g, _ in near))
    mean = sum(smooth) / max(1, len(smooth))
    bar = 0.25 * math.sqrt(sum((x - mean) ** 2 for x in smooth) / max(1, len(smooth)))
    best = [r for r, (_, _, _, outside, inside) in zip(ratio, lines, strict=True) if not outside and (inside or not article)]
    least = min(0.3, max(best) / 2) if best else 0.3
    out, regions, now = [], [], []
    for i, x in enumerate([*smooth, -1.0]):
        if x >= bar:
            now.append(i)
        else:
            regions.append(now)
            now = []
    for region in regions:
        own = [i for i in region if ratio[i] >= least and ratio[i] > 0]
        for i in region:
            text, _, links, outside, inside = lines[i]
            between = own and own[0] < i < own[-1] and not outside and (inside or not article) and 2 * links <= len(text)
            if i in own or between:
                out.append(text)
    return out


def test_equals_the_plain_method():
    rng = random.Random(4)
    for _ in range(300):
        lines = [("x" * rng.choice([1, 3, 20, 200, 900]), rng.randint(0, 6), rng.choice([0, 0, 0, 2, 30]), rng.random() < 0.3, rng.random() < 0.5)
                 for _ in range(rng.randint(0, 25))]
        assert html_text.select(lines) == plain_select(lines)


def test_ratios_decide_pages(spark, sf):
    """On the given pages, whose article is known by its element, the weighted ratios find its lines; lines of text and
    of no text are told apart by the ratios: without them (all alike) menus come with the text."""
    for r in spark.read.parquet(f"{sf}/pages.parquet").select("html").collect():
        parser = html_text._Lines()
        parser.feed(r.html)
        lines = parser.finish()
        assert html_text.select(lines) == [line[0] for line in lines if line[4] and not line[3]] == plain_select(lines)


def test_deep_and_long_pages():
    assert html_text.main_text("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    assert html_text.main_text("<article><p>" + "word " * 200_000 + "</article>") == ("word " * 200_000).strip()


def test_rows(spark):
    rows = [(i, f"u{i}", html, "t") for i, (html, _) in enumerate(PAGES.values())] + [(None, None, "x", "t"), (0, "u0", PAGES["article"][0], "t")]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    texts = [t for _, t in PAGES.values()]
    assert len(out) == len(rows)
    for r in out:
        assert r.text == ("x" if r.page_id is None else texts[r.page_id]) and r.n_chars == len(r.text)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
