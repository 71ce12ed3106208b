"""Main text: the cut decides, odd pages, and a brute-force truth for the pages' table."""

import html
import re

import numpy as np

from plumbline.llm import maincontent as m
from plumbline.llm.sample_pages import labelled_page

#: Labelled pages seen neither by the classifier nor in the choice of the edges' strength.
HELD_OUT = range(1000, 1200)


def f1(pages, model):
    hit = said = true = 0
    for blocks, y in pages:
        got = np.array(m.kept(blocks, model), bool)
        hit, said, true = hit + (got & y).sum(), said + got.sum(), true + y.sum()
    return 2 * hit / (said + true)


def test_the_cut_mends_the_classifier_where_no_element_tells():
    model = m.trained()
    assert model.smooth > 0
    pages = [m.labelled(p) for p in map(labelled_page, HELD_OUT) if not re.search("<article|<main", p)]
    assert len(pages) > 50
    assert f1(pages, model) > f1(pages, m.Model(model.weights, 0.0)) + 0.004
    assert f1(pages, model) > 0.95


def test_the_cut_reaches_max_flow(monkeypatch):
    calls, old = [], m._max_flow
    monkeypatch.setattr(m, "_max_flow", lambda *a: calls.append(1) or old(*a))
    for k in HELD_OUT:
        m.kept(m.labelled(labelled_page(k))[0], m.trained())
    print(f"max-flow on {len(calls)} of {len(HELD_OUT)} pages")
    assert len(calls) > 0.15 * len(HELD_OUT)


def test_a_doubtful_block_goes_with_its_surroundings():
    long = "The river rose in the night, and by morning the road was under water; nobody had seen such a flood. " * 3
    page = f"<nav>Home</nav><div><div>{long}</div><div>He left</div><div>{long}</div></div><footer>&copy; us</footer>"
    blocks, model = m.blocks_of(page), m.trained()
    alone = m.kept(blocks, m.Model(model.weights, 0.0))
    assert alone == [False, True, False, True, False] and m.kept(blocks, model) == [False, True, True, True, False]


def test_readers_comments_without_an_article_are_left_out():
    long = "The river rose in the night, and by morning the road was under water; nobody had seen such a flood. " * 3
    comment = "<div><b>Ann Bell</b><p>I saw it too, it was dreadful.</p></div>"
    page = f"<div class=entry-content><h1>A flood</h1><p>{long}</p><p>{long}</p><div><h3>3 comments</h3>{comment * 3}</div></div>"
    text = m.main_text(page)
    assert text.count("The river rose in the night") == 6 and "dreadful" not in text and "comments" not in text
    # a count of comments beside the title isn't their heading
    text = m.main_text(f"<article><h1>A flood</h1><p>2 comments</p><p>{long}</p></article>")
    assert text.count("The river rose in the night") == 3


def test_pages_of_the_table_by_their_own_layout(spark):
    """There the article is what stands between its tags: headings and paragraphs."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in m.extracted(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    tried = 0
    for r in rows:
        found = re.findall(r"<article>(.*?)</article>", r.html or "", re.S)
        if len(found) == 1 and not re.search(r"<(?!/?(?:p|b|i|br|h1|a|em|strong)\b)", found[0]):
            parts = [re.sub(r"\s+", " ", html.unescape(re.sub("<br>", " ", re.sub(r"<(?!br)[^>]*>", "", x)))).strip() for x in re.split(r"</?(?:p|h1)>", found[0])]
            assert got[r.page_id].text == "\n\n".join(filter(None, parts))
            tried += 1
    assert tried > 100


def test_odd_tables_and_pages(spark):
    shape = "page_id long, url string, html string, text string, n_chars string"
    long = "The bridge held, old as it was; nobody had hoped for that. " * 5
    page = f"<article><p>{long}</p></article>"
    rows = [(1, "u", page, "x", "y"), (1, "u", page, "x", "y"), (2, None, "<", "x", "y"), (3, "u", "<p>" * 3 + long, None, None)]
    got = m.extracted(spark.createDataFrame(rows, shape)).collect()
    assert [r.text for r in got if r.page_id == 1] == [long.strip()] * 2 and {len(r) for r in got} == {4}
    assert m.extracted(spark.createDataFrame([], shape)).count() == 0


def test_deep_and_long_pages():
    deep = "<div>" * 60_000 + "<p>Down here, a sentence; and more of it, long enough to be read.</p>" + "</div>" * 60_000
    assert len(m.blocks_of(deep)) == 1
    wide = "<article>" + "<p>A sentence stands here, as in all of them; it is read.</p>" * 20_000 + "</article>"
    assert m.main_text(wide).count("\n\n") == 19_999
    assert len(m.blocks_of("</div><svg>" * 20_000 + "<p>x")) == 1
