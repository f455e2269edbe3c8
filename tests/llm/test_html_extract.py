"""Main text of pages whose article is known."""

import collections
import random
import time

import pytest

from killgrid.llm import html_extract

PROSE = "Here is one sentence, with commas, and then another one, which is long enough to read like prose."


def paragraph(random, n=3):
    return " ".join(f"{random.choice('ABCDEFGH')}{' '.join(random.choices(['stone', 'river', 'and', 'water', 'over', 'a', 'field'], k=12))}, {random.randint(1, 999)}." for _ in range(n))


@pytest.mark.parametrize("name", ["community", "discussion", "tools", "extra", "content", "tags", "alert", "widget"])
@pytest.mark.parametrize("box", ["div", "section"])
def test_names_take_no_prose_out_of_an_article(name, box):
    page = f"<body><nav><a href=x>Home</a></nav><article><h1>Title</h1><p>{PROSE}</p><p>{PROSE} Two.</p><{box} class='{name}'><p>{PROSE} Inner.</p></{box}><div id='{name}'><p>{PROSE} Last.</p></div></article></body>"
    assert html_extract.extract(page) == "\n\n".join(["Title", PROSE, f"{PROSE} Two.", f"{PROSE} Inner.", f"{PROSE} Last."])


@pytest.mark.parametrize("name", ["ad", "ads-top", "cookie-notice", "comments", "sidebar", "newsletter", "share", "related", "notice"])
def test_furniture_goes(name):
    for at in (0, 1, 2):
        parts = [f"<p>{PROSE} One.</p>", f"<p>{PROSE} Two.</p>"]
        parts.insert(at, f"<div class='{name}'><p>{PROSE} Not of the article.</p></div>")
        for a, b in (("<article>", "</article>"), ("<div id='story'>", "</div>"), ("", "")):
            assert html_extract.extract(f"<body>{a}{''.join(parts)}{b}</body>") == f"{PROSE} One.\n\n{PROSE} Two."


HEADING_IDS = "related-work header-files share-prices consent social-history navigation-at-sea notice-periods menu-planning banner subscription-models ads-in-the-press comments-on-method cookies-in-history the-social".split()
BOXES = ["ad", "ads-top", "cookie-notice", "reader-comments", "commentList", "side-bar", "newsletter-signup", "share-buttons", "related-posts", "site-notice", "adSlot", "social-links", "promo-box-2", "cookie-banner"]


@pytest.mark.parametrize("name", HEADING_IDS)
def test_sections_keep_their_prose_whatever_their_heading(name):
    section = f"<section id='{name}'><h2>A heading</h2><p>{PROSE} a</p><p>{PROSE} b</p><p>{PROSE} c</p></section>"
    page = f"<body><article><h1>T</h1><section id=intro><h2>Intro</h2><p>{PROSE}</p></section>{section}<section id=results><h2>Results</h2><p>{PROSE}</p></section></article></body>"
    assert html_extract.extract(page) == "\n\n".join(["T", "Intro", PROSE, "A heading", *(f"{PROSE} {x}" for x in "abc"), "Results", PROSE])


def test_boxes_that_only_look_like_sections_go():
    for inner in (f"<h3>We ask</h3><p>{PROSE}</p><p>{PROSE}</p><button>Yes</button>", f"<h3>More</h3><p><a href=x>{PROSE}</a></p><p><a href=y>{PROSE}</a></p>", f"<p>{PROSE}</p><p>{PROSE}</p>"):
        page = f"<body><article><p>{PROSE} One.</p><div id='consent'>{inner}</div><p>{PROSE} Two.</p></article></body>"
        assert html_extract.extract(page) == f"{PROSE} One.\n\n{PROSE} Two."


def test_sources_stay_and_menus_go():
    links = "".join(f"<li><a href={i}>Title {i} of a work</a></li>" for i in range(4))
    page = f"<body><article><h1>T</h1><p>{PROSE}</p><p>{PROSE}</p><ul>{links}</ul><p>{PROSE}</p><h2>Sources</h2><ul>{links}</ul></article></body>"
    assert html_extract.extract(page).split("\n\n") == ["T", PROSE, PROSE, PROSE, "Sources", *(f"Title {i} of a work" for i in range(4))]


def test_blocks_of_labelled_pages():
    """Precision and recall of blocks on pages with sections of any heading and boxes of any furniture."""
    random.seed(21)
    hit = said = wanted = 0
    for k in range(200):
        own, parts = [f"Title {k}"], [f"<h1>Title {k}</h1>"]
        for i in range(random.randint(2, 6)):
            if random.random() < 0.4:
                parts.append(f"<div class='{random.choice(BOXES)}'><p>{paragraph(random, 1)} box {i}</p></div>")
            prose = [paragraph(random) for _ in range(random.randint(2, 4))]
            own += [f"Head {i}", *prose]
            parts.append(f"<section id='{random.choice(HEADING_IDS)}'><h2>Head {i}</h2>{''.join(f'<p>{x}</p>' for x in prose)}</section>")
        a, b = random.choice([("<article>", "</article>"), ("<div class='post-body'>", "</div>")])
        page = f"<body><nav><a href=/>Home</a></nav>{a}{''.join(parts)}{b}<div id='{random.choice(BOXES)}'><p>{paragraph(random)}</p></div><footer><p>{paragraph(random)}</p></footer></body>"
        got = html_extract.extract(page).split("\n\n")
        hit, said, wanted = hit + len(set(got) & set(own)), said + len(set(got)), wanted + len(set(own))
    assert hit / said > 0.995 and hit / wanted > 0.995, (hit / said, hit / wanted)


def test_a_page_whose_prose_is_all_in_one_named_box():
    assert html_extract.extract(f"<body><div class='modal'><p>{PROSE}</p><p>{PROSE}</p></div></body>") in ("", f"{PROSE}\n\n{PROSE}")
    many = "".join(f"<p>{PROSE} {i}</p>" for i in range(40))
    assert html_extract.extract(f"<body><p>Menu of the site, with words</p><div class='overlay'>{many}</div></body>").count(PROSE) == 40


def test_generated_pages():
    random.seed(8)
    for k in range(150):
        own = [paragraph(random) for _ in range(random.randint(2, 8))]
        blocks = [f"<p>{x.replace('river', '<b>river</b>').replace(' and ', ' &#97;nd' + chr(10) + '  ')}" + random.choice(["</p>", ""]) for x in own]
        junk = [f"<nav><ul>{''.join(f'<li><a href={i}>{i} words of a menu</a>' for i in range(9))}</ul></nav>", f"<aside><p>{paragraph(random)}</p></aside>", f"<div class=ad>{paragraph(random, 1)}</div>", f"<form><label>{paragraph(random, 1)}</label></form>", f"<div class='comments'><div class=comment><p>{paragraph(random)}</p></div></div>", f"<script>var a='<p>{paragraph(random)}</p>'</script>", f"<footer><p>{paragraph(random)}</p></footer>", f"<!-- <p>{paragraph(random)}</p> -->", f"<header><p>{paragraph(random)}</p></header>"]
        random.shuffle(junk)
        a, b = random.choice([("<article>", "</article>"), ("<main><div>", "</div></main>"), ("<div class='post'>", "</div>")])
        page = f"<!DOCTYPE html><html><body>{''.join(junk[:5])}{a}<h1>Title {k}</h1>{''.join(blocks)}{b}{''.join(junk[5:])}</body></html>"
        assert html_extract.extract(page) == "\n\n".join([f"Title {k}", *own]), page


def test_deep_nesting_is_linear():
    for page in ("<div>" * 100_000 + f"<p>{PROSE}</p>", "<ul><li>" * 50_000 + f"<p>{PROSE}</p>", "</div>" * 100_000 + f"<p>{PROSE}</p>", "<p>" + "<b>" * 100_000 + PROSE, "<" * 100_000 + f"<p>{PROSE}</p>"):
        start = time.process_time()
        assert PROSE in html_extract.extract(page)
        assert time.process_time() - start < 1.5


def test_elements_without_attributes_have_no_names_to_read(monkeypatch):
    read = []
    names = html_extract._furniture_words
    monkeypatch.setattr(html_extract, "_furniture_words", lambda name: read.append(name) or names(name))
    assert html_extract.extract(f"<div><ul ><li\n><b></b></ul></div><div class='post'><p>{PROSE}</p></div>") == PROSE
    assert read == ["post", ""]


@pytest.mark.parametrize("page", ["<div><p>one</p>" * 20_000, "<div><h2>Sources</h2><p>one</p>" * 10_000, f"{'<svg/>' * 60_000}<p>one</p>"])
def test_blocks_and_empty_elements_of_any_number_are_linear(page):
    start = time.process_time()
    assert "one" in html_extract.extract(page)
    assert time.process_time() - start < 5


def test_rows_of_every_kind(spark):
    page = f"<article><h1>T</h1><p>{PROSE}</p></article>"
    rows = [(1, "u", page, "x", 1), (1, "u", page, "x", 1), (2, None, None, None, 2), (None, "v", "", "y", None), (3, "w", "no markup, just words", "z", 4), (4, "big", f"<p>{'word, ' * 200_000}</p>", "z", 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, Text string, N_chars int")
    got = collections.Counter((r.page_id, r.url, r.text[:100], r.n_chars) for r in html_extract.extract_pages(pages).collect())
    text = f"T\n\n{PROSE}"
    assert got == collections.Counter([(1, "u", text[:100], len(text))] * 2 + [(2, None, "", 0), (None, "v", "", 0), (3, "w", "no markup, just words", 21), (4, "big", ("word, " * 20)[:100], 1_199_999)])
    assert html_extract.extract_pages(pages.limit(0)).count() == 0
