"""What the minimum cut of the main text does, and what it does without names of elements."""

import itertools
import os
import random
import re

import pytest

from chronoreel.llm import html_text

SENTENCE = "The river rose over the road in the night, and in the morning the house stood in a wide and quiet lake."
NAMED = re.compile(r"\s(?:class|id|role)\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")


def test_the_cut_mends_more_than_it_breaks_on_held_out_pages():
    w = html_text.weights()
    wrong = alone = flips = right = n = 0
    for page, labels in html_text.labelled_pages(seed=77, pages=300):
        gain, edges = html_text.graph(page, w)
        for g, cut, truth in zip(gain, html_text.min_cut(gain, edges) if gain else [], labels, strict=True):
            n += 1
            alone += (g > 0) != bool(truth)
            wrong += cut != bool(truth)
            flips += (g > 0) != cut
            right += (g > 0) != cut and cut == bool(truth)
    print(f"{n} blocks, {flips} decided by the cut, {right} of them rightly; errors {alone} without it, {wrong} with it")
    assert n > 4000 and flips >= 40 and right > 0.6 * flips and wrong < 0.88 * alone


def brute(page, w):
    """The labelling of least cost among all, blocks of main text joined."""
    gain, edges = html_text.graph(page, w)

    def cost(labels):
        return sum(-g for g, x in zip(gain, labels, strict=True) if x) + sum(c for a, b, c in edges if labels[a] != labels[b])

    # Of equal ones the cut keeps the larger side; the costs of these pages have no ties.
    best = min(itertools.product((False, True), repeat=len(gain)), key=cost)
    return "\n".join(b.text for b, keep in zip(page.blocks, best, strict=True) if keep)


def test_pages_equal_the_best_of_all_labellings():
    w, small = html_text.weights(), 0
    for page, _ in html_text.labelled_pages(seed=5, pages=150):
        if 0 < len(page.blocks) <= 13:
            small += 1
            assert html_text.kept(page, w) == brute(page, w)
    assert small >= 40


@pytest.mark.parametrize("shell", ["<form id=aspnetForm method=post><input type=hidden name=v>%s</form>", "<form><article>%s</article></form>", "<form><div>%s</div><input name=q><button>Go</button></form>"])
def test_a_page_in_a_form_is_no_form(shell):
    body = f"<h1>A title of the page</h1><p>{SENTENCE}</p><p>{SENTENCE[::-1]}.</p>" + f"<p>{SENTENCE}</p>" * 6
    found = html_text.main_text(f"<body><nav><a href=x>Home</a> <a href=y>News</a></nav>{shell % body}<footer>All rights reserved by the owner.</footer></body>").split("\n")
    assert found[:2] == ["A title of the page", SENTENCE] and len([x for x in found if x == SENTENCE]) == 7 and "All rights" not in " ".join(found)


def test_forms_in_and_around_an_article_stay_out():
    ask = "<form><label>Your name</label><input name=n><p>Tell us what you think of this and we will write back to you soon.</p><textarea></textarea><button>Send it now</button></form>"
    found = html_text.main_text(f"<body>{ask}<article><h1>A title</h1><p>{SENTENCE}</p>{ask}<p>{SENTENCE[::-1]}.</p></article>{ask}</body>")
    assert found == f"A title\n{SENTENCE}\n{SENTENCE[::-1]}."
    # Forms do not nest, and one that is not closed ends with what holds it.
    assert SENTENCE in html_text.main_text(f"<div><form><form><input><p>Search here</p></div><article><p>{SENTENCE}</p></article>")


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_names_removed_change_few_pages():
    import duckdb

    pages = [h for (h,) in duckdb.sql("SELECT html FROM read_parquet('/root/testdata/sf0.01/pages.parquet')").fetchall()]
    w = html_text.weights()
    changed = sum(html_text.kept(html_text.Page(h or ""), w) != html_text.kept(html_text.Page(NAMED.sub("", h or "")), w) for h in pages)
    assert changed <= len(pages) // 50


def test_any_soup_of_tags_is_read():
    rng = random.Random(6)
    parts = ["<form>", "</form>", "<article>", "</article>", "<p>", "<div class=ad>", "</div>", "<input>", "<button>", "</button>", "<main>", SENTENCE, "<table>", "<td>", "</table>", "<a href=x>", "</a>"]
    for _ in range(200):
        page = html_text.Page("".join(rng.choices(parts, k=rng.randint(1, 40))))
        assert page._form < len(page._controls)
        html_text.kept(page, html_text.weights())
