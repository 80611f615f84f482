"""Main text of hand-made pages, exactly: heads, articles and tails of many kinds, put together in all ways."""

import random
from dataclasses import replace

import numpy as np

from sheaf.llm import html_main

W40 = " ".join(f"word{k}" for k in range(40))
W25 = " ".join(f"say{k}" for k in range(25))
LINKED = "The committee has published <a href=r>the full report</a> for all members."

HEADS = [
    "<nav><a href=a>Home page</a> <a href=b>All our news</a> <a href=c>Sport and games</a> <a href=d>The weather today</a> <a href=e>Contact the desk</a></nav>",
    "<header class=top><a href=/>The Daily Word</a><nav><ul><li><a href=a>News</a><li><a href=b>Sport</a></ul></nav></header><div class='cookie-banner'>We use cookies, as <a href=c>our policy</a> says. <a href=d>Settings and choices</a></div>",
    "<div id=menu><a href=a>One</a> | <a href=b>Two</a> | <a href=c>Three</a></div><div class=notice><p>The site will be closed for repairs on Sunday night; see <a href=s>the status page</a> for more.</p></div>",
    "<div class='ad banner'>Buy the best shoes of the year now at <a href=x>half the price</a> while they last.</div>",
    "<form action=s><input name=q><button>Search this site</button></form><ul class=breadcrumb><li><a href=a>Start</a><li><a href=b>Politics and the world</a></ul><script>if (1 < 2) document.write('<p>no</p>')</script>",
]
#: (markup, text)
BODIES = [
    (f"<article><h1>A title</h1><p>{W40}</p><p>See <a href=r>the report</a> for details.</p><p>{W25}</p></article>", ["A title", W40, "See the report for details.", W25]),
    (f"<article><h1>T</h1><p>{W40}</p><p>Ok, that is all we know.</p></article>", ["T", W40, "Ok, that is all we know."]),
    (f"<main><h1>What happened on the hill</h1><p>{LINKED}</p><p>{W25}</p><blockquote>It was late.</blockquote><p>{W40}</p><p><a href=m>Minutes of the meeting</a></p><p>No more.</p></main>", ["What happened on the hill", "The committee has published the full report for all members.", W25, "It was late.", W40, "Minutes of the meeting", "No more."]),
    (f"<div class='post-content'><h2>Notes</h2><p>Short.</p><p>{W40}</p><ul><li><a href=a>First source of this</a><li><a href=b>Second one</a></ul><p>{W25} &amp; <a href=c>so on</a></p></div>", ["Notes", "Short.", W40, "First source of this", "Second one", f"{W25} & so on"]),
]
TAILS = [
    "<footer>Copyright of the paper, all rights reserved. <a href=a>Terms of use</a> <a href=b>Privacy and you</a> <a href=c>Work with us</a></footer>",
    "<section id=comments><h3>Two comments</h3><div class=comment><p>I read <a href=x>this other piece</a> and liked it much more than yours.</p></div><div class=comment><p>Me too.</p></div></section><footer><a href=a>Imprint</a></footer>",
    f"<aside class=sidebar><h3>More</h3><p>{W25}</p><ul><li><a href=a>An older story about the hill</a><li><a href=b>Another</a></ul></aside><div class=newsletter><p>Get our letter each week.</p><form><button>Join</button></form></div>",
    f"<div class=comments><p>{W40}</p><p>I think <a href=u>someone</a> is wrong here.</p></div><style>p {{ color: red }}</style>",
]


def pages():
    """80 pages that name their parts, each with its text."""
    return [(f"<html><head><title>no</title></head><body>{head}{body}{tail}</body></html>", "\n".join(text)) for head in HEADS for body, text in BODIES for tail in TAILS]


#: Pages on which nothing is named.
PLAIN = [
    (f"<div><a href=a>Home page</a> <a href=b>All our news</a> <a href=c>Sport and games</a></div><h1>A day on the hill</h1><p>{W40}</p><p>{W25} <a href=r>as said before</a>.</p><p>{W40}</p><div>Copyright <a href=a>Terms of use</a> <a href=b>Privacy</a></div>", ["A day on the hill", W40, f"{W25} as said before.", W40]),
    (f"<p><a href=a>One</a> <a href=b>Two</a> <a href=c>Three and four</a></p><h2>Notes of a long day</h2><p>{W25}</p><p>{W40}</p><p>{W25}</p><p><a href=a>Older story</a></p><p><a href=b>Another story of ours</a></p>", ["Notes of a long day", W25, W40, W25]),
    (f"<h1>One day in the week</h1><p>{W40}</p><p>{W25}</p><p>{W40}</p>", ["One day in the week", W40, W25, W40]),
]


def test_pages_exactly():
    made = pages()
    right = sum(html_main.main_text(page) == text for page, text in made)
    assert len(made) == 80 and right >= 0.95 * len(made), right
    assert all(html_main.main_text(page) == "\n".join(text) for page, text in PLAIN)


def test_linked_blocks_of_pages_that_name_them():
    """A menu in one line, a banner, a footer and a comment with links go; a linked sentence and a short last paragraph stay."""
    for head, (body, text) in ((HEADS[0], BODIES[0]), (HEADS[1], BODIES[1])):
        for tail in TAILS[:2]:
            assert html_main.main_text(head + body + tail) == "\n".join(text)


def leaves(node):
    return [node.share] if node.below is None else leaves(node.below) + leaves(node.above)


def test_no_leaf_is_a_tie():
    shares = leaves(html_main.tree())
    assert len(shares) > 10 and not [s for s in shares if s == 0.5]


def test_words_and_links_alone():
    """With all zones blank the tree still finds most of the text: of main blocks and others of these pages, F1 of 0.9."""
    kept = left = missed = 0
    rng = random.Random(1)
    for _ in range(300):
        words = lambda a, b: " ".join(["w"] * rng.randint(a, b))
        links = lambda n: " ".join(f"<a href=x>{words(1, 3)}</a>" for _ in range(rng.randint(1, n)))
        body = "".join(f"<p>{words(12, 90)}{f' <a href=x>{words(1, 4)}</a>' if rng.random() < 0.3 else ''}</p>" for _ in range(rng.randint(2, 9)))
        page = f"<nav>{links(8)}</nav><nav><ul>{''.join(f'<li>{links(1)}' for _ in range(5))}</ul></nav><article><h1>{words(3, 10)}</h1>{body}</article><footer>{words(0, 4)} {links(5)}</footer>"
        found = html_main.blocks(page)
        main = np.array([b.zone > 0 for b in found])
        said = html_main.tree().predict(html_main.features([replace(b, zone=0) for b in found])) >= 0.5
        kept, left, missed = kept + (said & main).sum(), left + (said & ~main).sum(), missed + (~said & main).sum()
    assert 2 * kept / (2 * kept + left + missed) >= 0.9
