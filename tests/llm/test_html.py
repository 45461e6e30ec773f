import random
import time

import pytest

from plurality.llm import html_text as H

BODY = "The bridge over the river is closed for the season, and traders take the northern road to the market town instead. "


def measured(page, i):
    """(characters, tags, characters in links) of an element, by walking down."""
    if page.pruned[i]:
        return 0, 0, 0
    own = sum(len("".join(t.split())) for node, t in page.texts if node == i)
    chars, tags, linked = own, 0, 0
    for child in (j for j, up in enumerate(page.parents) if up == i and not page.pruned[j]):
        c, t, k = measured(page, child)
        chars, tags, linked = chars + c, tags + t + 1, linked + (c if page.tags[child] == "a" else k)
    return chars, tags, linked


@pytest.mark.parametrize("seed", range(6))
def test_counts_and_sums_equal_a_plain_walk(seed):
    rng = random.Random(seed)

    def tree(depth):
        tag = rng.choice(["div", "p", "section", "a", "ul", "aside", "span"])
        inner = "".join(rng.choice([BODY, "word ", ""]) if depth == 0 or rng.random() < 0.4 else tree(depth - 1) for _ in range(rng.randint(1, 4)))
        return f"<{tag} class='{rng.choice(['x', 'widget'])}'>{inner}</{tag}>"

    page = H.Page("<body>" + "".join(tree(4) for _ in range(4)) + "</body>")
    density, total, chars, linked = H.densities(page)
    in_link = lambda i: i > 0 and (page.tags[i] == "a" or in_link(page.parents[i]))
    for i in range(len(page.tags)):
        if not page.pruned[i]:
            c, t, k = measured(page, i)
            assert chars[i] == c and linked[i] == (c if in_link(i) else k)
            assert (density[i] > 0) <= (c > 0) and density[i] <= c / max(1, t) * 40
    weight = lambda i: (H.NAME_WEIGHT if page.named[i] else 1.0) * (weight(page.parents[i]) if i else 1.0)
    for i in range(len(page.tags)):
        below = sum(density[j] for j, up in enumerate(page.parents) if up == i)
        beside = 0 if page.pruned[i] else sum(len(t.strip()) for node, t in page.texts if node == i)
        assert abs(total[i] - weight(i) * (below + beside)) < 1e-6 * (1 + total[i])


def test_paragraphs_stay_whatever_their_class_and_named_boxes_go():
    page = f"<body><div class='menu'><a href=x>Home</a><a href=y>News</a></div><article><h1>Title</h1><p>{BODY}</p><p class='widget notice'>{BODY * 2}</p><p>{BODY}</p><div class='comments'><div>nice post</div><div>thanks</div></div><div class='related-links'><a href=z>Another story</a> <a href=q>And one more</a></div></article></body>"
    assert H.main_text(page) == " ".join(("Title " + BODY * 4).split())


@pytest.mark.parametrize("source", ["<a " * 300_000, "<div>" * 200_000, "<div>" * 30_000 + "</span>" * 200_000, "<b><td>" + "<span>" * 50_000 + "</b>" * 100_000, '<a "' * 200_000, "<script>" + "</script " * 200_000, "<a '>" * 100_001, "<p>" * 200_000, "x & y " * 200_000])
def test_hostile_pages_take_time_in_proportion(source):
    began = time.time()
    H.main_text(source)
    assert time.time() - began < 20


def test_odd_markup():
    assert H.main_text("<p>a < b and c > d, see <a title='x > y'>this</a> text</p>") == "a < b and c > d, see this text"
    assert H.main_text('<p title="never closed>one two</p><p>three four</p>') == "one two three four"
    assert H.main_text("") == H.main_text("<script>x") == H.main_text("<!-- never closed <p>text</p>") == ""


def test_edges(spark):
    page = f"<html><body><p>{BODY}</p></body></html>"
    rows = [(1, "u", page, "x", "y"), (1, "u", page, "x", "y"), (None, None, None, None, None), (2, "v", "", "x", "y"), (3, "w", "<p>" + BODY * 20_000, "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars string")
    got = H.extract_text(pages).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 0), (1, len(BODY) - 1), (1, len(BODY) - 1), (2, 0), (3, 20_000 * len(BODY) - 1)]
    assert H.extract_text(pages.limit(0)).count() == 0


def paragraphs(n, start=0):
    return "".join(f"<p>Paragraph {start + k}. {BODY}</p>" for k in range(n))


def plain(n, start=0):
    return " ".join(f"Paragraph {start + k}. {BODY.strip()}" for k in range(n))


LINKS = "".join(f"<a href='/{k}'>Menu entry {k}</a> " for k in range(20))


def test_both_articles_of_a_page_stay():
    page = f"<body><div>{LINKS}</div><article>{paragraphs(3)}</article><article>{paragraphs(6, 3)}</article><div>{LINKS}</div></body>"
    assert H.main_text(page) == plain(9)
    page = f"<body><main><article>{paragraphs(6)}</article><article>{paragraphs(3, 6)}</article></main><footer>{BODY}</footer></body>"
    assert H.main_text(page) == plain(9)


def test_sidebars_stay_out_without_article_or_main():
    page = f"<body><div>{LINKS}</div><div id=wrap><div id=content>{paragraphs(6)}</div><div id=sidebar>{paragraphs(3, 6)}</div></div></body>"
    assert H.main_text(page) == plain(6)
    page = f"<body><div>{LINKS}</div><div id=wrap><h1>{BODY}</h1><div id=content>{paragraphs(6)}</div><p>{BODY}</p></div></body>"
    assert H.main_text(page) == f"{BODY}{plain(6)} {BODY.strip()}"


def test_long_reader_comments_stay_out():
    said = "".join(f"<div class=comment><p>{BODY * 3}</p></div>" for _ in range(9))
    for inner in (f"<article>{paragraphs(4)}</article><section id=comments>{said}</section>", f"<article>{paragraphs(4)}<section id=comments>{said}</section></article>", f"<div>{paragraphs(4)}</div><div id=comments>{said}</div>"):
        assert H.main_text(f"<body><div>{LINKS}</div>{inner}</body>") == plain(4)
