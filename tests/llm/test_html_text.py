"""Templates against a plain count, what names may remove, and odd pages."""

import collections
import random
import time

import pytest

from inkstrata.llm import html_text


def site(seed=3, hosts=4, pages=30):
    """Pages whose template carries text under plain names, so that only counting can tell it."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    rows, wanted = [], {}
    for h in range(hosts):
        intro, boxes = f"Welcome to {word()}", [f"Offer {word()} {word()}" for _ in range(3)]
        for k in range(pages if h else 3):
            text = " ".join(word() for _ in range(rng.randrange(5, 60)))
            some = [b for b in boxes if rng.random() < 0.6]
            body = f"<div class='x{h}'><b>{intro}</b></div><div><p>{text}</p></div>" + "".join(f"<div class=q><span>{b}</span></div>" for b in some)
            i = h * 1000 + k
            rows.append((i, f"http://h{h}.example/{k}", f"<html><body>{body}</body></html>", "n", 1, "z"))
            wanted[i] = (text, "\n".join([intro, text, *some]))
    return rows, wanted


ODD = "page_id long, url string, html string, host string, templates int, hashes string"


def plain_templates(rows, share=html_text.SHARE, least=html_text.LEAST_PAGES):
    pages = collections.defaultdict(dict)
    for _, url, html, *_ in rows:
        pages[url.split("/")[2]][html] = html_text.template_hashes(html)
    out = {}
    for host, own in pages.items():
        counts = collections.Counter(x for hashes in own.values() for x in set(hashes))
        out[host] = {x for x, n in counts.items() if n >= least and n >= share * len(own)}
    return {h: t for h, t in out.items() if t}


def test_templates_against_plain_counts(spark):
    rows, _ = site()
    rows += rows[:40]  # copies count once
    found = {r["host"]: set(r["templates"]) for r in html_text.templates(spark.createDataFrame(rows, ODD)).collect()}
    assert found == plain_templates(rows) and len(found) == 3


@pytest.mark.parametrize("broadcast_hashes", [0, 10**6])
def test_counting_decides_the_text(spark, broadcast_hashes):
    rows, wanted = site()
    out = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, ODD), broadcast_hashes).collect()}
    for i, (text, whole) in wanted.items():
        assert out[i] == (text if i >= 1000 else whole)  # three pages are too few to tell
        assert html_text.main_text(next(r[2] for r in rows if r[0] == i)) == whole  # without the templates, the result is another


def test_names_inside_an_article():
    text = html_text.main_text
    assert text('<article><h1 class="entry-header">Title</h1><p class="ad">x</p></article>') == "Title\nx"
    assert text('<article><section id="binary-search"><p>s</p></section><div class="post-header">h</div><div class="notice-board">n</div></article>') == "s\nh\nn"
    assert text('<article><p>a</p><div class="related-posts">r</div><div class="ad-slot-2">d</div><ul class="share-buttons"><li>s</ul><div id="comments">c</div><nav>n</nav></article>') == "a"
    assert text('<div class="site-header">h</div><div class="cookie-notice">c</div><p>p</p>') == "p"


def test_forms_that_frame_the_page():
    text = html_text.main_text
    assert text("<body><form id=aspnet><div><article><h1>T</h1><p>b<form><input>no</form></article></div></form></body>") == "T\nb"
    assert text(f"<body><form><p>{'word ' * 50}</p></form><p>small</p><nav>{'menu ' * 500}</nav></body>") == " ".join(["word"] * 50) + "\nsmall"
    assert text(f"<body><p>{'word ' * 50}</p><form><p>sign up</p></form></body>") == " ".join(["word"] * 50)


@pytest.mark.parametrize("page", ["<i>{}</b>", "<center><i>{}", "<ul><i>{}<li>x", "<form>{}x", "<b>{}<div></b>", "<!--{}", '<a href="{}', "<p>{}x</p>"])
def test_deep_and_long_pages_take_linear_time(page):
    opening = page.split("{}")[0]
    began = time.process_time()
    html_text.main_text(page.format(opening * 20_000))
    assert time.process_time() - began < 10  # a quadratic walk of 20,000 elements takes minutes
