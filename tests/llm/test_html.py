import itertools
import random
import re
import time

import pytest

from siftwork.llm import html
from siftwork.llm.mincut import source_side

W = html.model()

PAGES = [
    (
        """<html><head><title>T</title><script>if (a<b) document.write("<p>no</p>")</script></head><body>
        <div id="header"><a href="/">Site name</a></div>
        <div class="navbar"><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li><li><a href=3>About</a></li></ul></div>
        <div id="cookie-notice">We use cookies to improve your visit. <button>OK</button></div>
        <div class="content"><h1>A day at the sea</h1><p>We went to the sea&nbsp;early. The water was cold, and the
          wind&mdash;strong.</p><div class="ad">Buy our boats now!</div>
          <p>Later we saw <a href="/b">a boat</a> &amp; two birds.<br>They flew away.</p><ul><li>one bird was grey.</li><li>one was white.</li></ul></div>
        <div class="sidebar"><h3>Popular</h3><ul><li><a href=4>Ten hats</a></li></ul></div>
        <form action="/s"><p>Search the site</p><input name=q></form>
        <div id="comments"><p>Nice text, thank you for it.</p><p>I liked the birds.</p></div>
        <div class="footer">&copy; 2020 Site name. All rights reserved.</div></body></html>""",
        "A day at the sea\nWe went to the sea early. The water was cold, and the wind—strong.\nLater we saw a boat & two birds. They flew away.\none bird was grey.\none was white.",
    ),
    (
        """<body><header><h1>Daily</h1><nav><a href=a>A</a> <a href=b>B</a></nav></header><main><article><h2>Rain in May</h2>
        <p>It rained for three days.<p>The river rose &lt;a lot&gt;.</article></main><aside><p>Sign up for the letter. It is free.</p></aside>
        <section class="comments"><article class="comment"><p>It rained here too, and a lot.</p></article></section><footer><p>Contact us at any time. Terms apply.</p></footer>""",
        "Rain in May\nIt rained for three days.\nThe river rose <a lot>.",
    ),
    ("<p>One sentence alone, without any frame around it.</p>", "One sentence alone, without any frame around it."),
    (None, ""),
    ("", ""),
    ("<nav><ul><li><a href=x>Menu</a></li></ul></nav>", ""),
    ("<p>broken <b>tags <i>never</b> close", "broken tags never close"),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_pages(page, text):
    assert html.main_text(page, W) == text


ARTICLE = "<h1>A day at the sea</h1><p>We went to the sea early in the morning. The water was cold.</p><p>Later we saw a boat and two birds. They flew away.</p>"
TEXT = "A day at the sea\nWe went to the sea early in the morning. The water was cold.\nLater we saw a boat and two birds. They flew away."
MENU = "<nav><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul></nav>"
FOOT = "<footer>&copy; 2020 Site name. All rights reserved.</footer>"


@pytest.mark.parametrize(
    "frame",
    [
        '<div class="overflow hidden md">{}</div>',
        '<article title="the hidden valley">{}</article>',
        '<article data-x="aria-hidden=true">{}</article>',
        '<div class="layout with-sidebar"><article>{}</article></div>',
        '<div class="layout with-sidebar"><div class="content">{}</div></div>',
        '<div id="page" class="has-footer comments-open"><main>{}</main></div>',
        "<form action=/s><article>{}</article></form>",
        "<article>{}</article>",
        "<main>{}</main>",
        "<div id=content><div class=inner>{}</div></div>",
        "<article><p hidden>Not this one here.</p><p style='color:red; display: none'>Nor this.</p>{}</article>",
        "<script/>x</script><article>{}</article>",
        "<article>{}</article><form><p>Search the whole site for words.</p></form>",
        "<article>{}</article><!-->x--><!-- > <p>y</p> --><![CDATA[ <p>z</p> ]]><?php <p ?>",
        '<article>{}</article><a title="1 > 0"></a>',
    ],
)
@pytest.mark.parametrize("around", ["{}", MENU + "{}" + FOOT])
def test_frames(frame, around):
    got = html.main_text("<html><head><title>T</title></head><body>" + around.format(frame.format(ARTICLE)) + "</body></html>", W)
    if "<!-->" in frame:
        got = got.replace("\nx-->", "")
    assert got == TEXT


def test_headline_in_a_header():
    page = "<article><header><h1>A day at the sea</h1></header>" + ARTICLE[ARTICLE.index("<p>") :] + "</article>"
    assert html.main_text(f"<header><p>Daily news of the town</p></header>{page}{FOOT}", W) == TEXT


def test_page_within_a_form():
    page = f"<form id=aspnet><div class=header>Site</div><div class=content>{ARTICLE * 4}</div></form>"
    assert html.main_text(page, W) == "\n".join([TEXT] * 4)


def test_head_that_is_not_closed():
    assert html.main_text("<html><head><title>T</title><meta x><body><article>" + ARTICLE, W) == TEXT


@pytest.mark.parametrize(
    "piece", ['<a b="', "<a b='\"", "<", "<!", "</a", "<a<", "<a ", "<!--x", "<div>x", "<p>x</b>", "<i>", "<b></u>", '<a b=">" ', "<script>", "</script", "<a b=c d", "<form>x", "<a  =", "&am", "<td>", "<li>x<ul>"]
)
def test_time_grows_with_length(piece):
    """Half a megabyte of broken markup; what takes time in the square of that would run for hours."""
    page = "<article><p>The quick fox saw the lazy dog today.</p>" + piece * (500_000 // len(piece))
    began = time.perf_counter()
    html.main_text(page, W)
    html.main_text(page + ">", W)
    assert time.perf_counter() - began < 60


def test_cut_is_minimal():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 7)
        net = [rng.choice([-3, -2, -1, 0, 1, 2, 3]) * rng.random() for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.random()) for _ in range(rng.randint(0, 12))]

        def cost(side, net=net, edges=edges):
            return sum(x for x, s in zip(net, side) if x > 0 and not s) - sum(x for x, s in zip(net, side) if x < 0 and s) + sum(c for i, j, c in edges if side[i] != side[j])

        best = min(cost(s) for s in itertools.product([False, True], repeat=n))
        assert cost(source_side(net, edges)) == pytest.approx(best, abs=1e-6)


def test_long_page():
    page = "<article>" + "<p>The quick fox saw the lazy dog today.</p>" * 20_000 + "</article>" + "<footer>x</footer>"
    assert html.main_text(page, W).count("\n") == 19_999


def test_rows(spark):
    rows = [(1, "u", PAGES[1][0], "x"), (1, "u", PAGES[1][0], "x"), (None, None, None, None)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, 61), (1, 61)]
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_stop_words_are_counted_in_whole_blocks():
    (block,) = html.blocks_of("<p>" + "xyzzy " * 500 + "the " * 499 + "the.</p>")
    (other,) = html.blocks_of("<p>" + "the " * 500 + "xyzzy " * 499 + "xyzzy.</p>")
    at = html.FEATURES.index("stops")
    assert html.features([block])[0, at] == html.features([other])[0, at] == 1
    (tail,) = html.blocks_of("<p>" + "xyzzy " * 900 + "the " * 99 + "xyzzy.</p>")
    assert abs(html.features([tail])[0, at] - 0.297) < 1e-9


SENTENCES = "We went to the sea early in the morning. The water was cold and the wind was strong. "
PLAIN = [
    ("<div>{}</div>".format(SENTENCES * 20), (SENTENCES * 20).strip()),
    ("<body><div id=page>{}</div></body>".format(f"<div>{SENTENCES}</div>" * 8), "\n".join([SENTENCES.strip()] * 8)),
    ("<body>{}{}{}</body>".format(MENU, f"<section>{SENTENCES}</section>" * 8, FOOT), "\n".join([SENTENCES.strip()] * 8)),
    ("<body>{}<div><div>{}</div></div>{}</body>".format(MENU, f"<div><div>{SENTENCES}</div></div>" * 5, FOOT), "\n".join([SENTENCES.strip()] * 5)),
    ("<body><div class=x1><span>{}</span></div></body>".format(SENTENCES * 4), (SENTENCES * 4).strip()),
    ("<body><table><tr><td>{}</td></tr></table></body>".format(SENTENCES * 4), (SENTENCES * 4).strip()),
    (SENTENCES * 3, (SENTENCES * 3).strip()),
]


@pytest.mark.parametrize(("page", "text"), PLAIN)
def test_text_in_elements_that_say_nothing(page, text):
    assert html.main_text(page, W) == text


def test_forms_beside_an_article():
    """However much a form says, it goes; one around the page's parts stays."""
    form = "<form action=/s>" + f"<p>{SENTENCES}</p>" * 30 + "<input name=q></form>"
    assert html.main_text(f"<body>{MENU}<article>{ARTICLE}</article>{form}{FOOT}</body>", W) == TEXT
    assert html.main_text(f"<body>{MENU}{form}<div>{ARTICLE}</div>{FOOT}</body>", W) == TEXT
    assert html.main_text(f"<body><a href=#x>Skip</a><form id=aspnet>{MENU}<div>{ARTICLE}</div>{FOOT}</form></body>", W) == TEXT
    assert html.main_text(f"<body><form><div><main>{ARTICLE}</main></div></form></body>", W) == TEXT
    assert html.main_text("<body><form><p>Your name and your password, please. We keep both.</p><input name=q></form></body>", W) == ""


def test_references_end_with_their_text_node():
    assert html.main_text("<p>We know AT&<b>amp;</b>T and &lt<b>;</b> and &amp;lt; and &#x41;&#66; and a&nbsp;b, as all of us do.</p>", W) == "We know AT&amp;T and <; and &lt; and AB and a b, as all of us do."


def test_made_up_pages_are_told_apart():
    """Pages of other seeds than those that the weights come from: nearly all blocks are right."""
    rng, right, every = random.Random(99), 0, 0
    for _ in range(150):
        made = html._made_up(rng)
        whole = "".join(re.sub(r">(?=[^<\s])", f">\x01{k}\x02 ", part) if part.count("<") > 1 else part for k, (part, _) in enumerate(made))
        found = html.parsed(f"<body>{whole}</body>")
        part = [int(html.MADE.search(b.text)[1]) for b in found.blocks]
        for b in found.blocks:
            b.text = html.MADE.sub("", b.text).strip() or "-"
        want = [made[k][1] for k in part]
        right += sum(a == b for a, b in zip(html.label(found, W), want))
        every += len(want)
    assert right > 0.97 * every
