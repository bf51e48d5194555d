"""Main texts of generated pages: whole results, for nested articles of many shapes."""

from __future__ import annotations

import random

import pytest

from pagemark.llm import wrappers


def texts(spark, pages, parts=2):
    """pages: (page_id, host, html)."""
    df = spark.createDataFrame([(i, f"http://{h}/{i}", x) for i, h, x in pages], "page_id long, url string, html string").repartition(parts)
    return {r.page_id: r.text.split("\n\n") for r in wrappers.extract(df).collect()}


LONG = "The long part of {0} says a good deal more than all the rest together, and goes on. " * 6


@pytest.mark.parametrize("name", ["section class=part", "div class=body-text", "div", "section id=related-work"])
def test_titles_introductions_and_conclusions_stay(spark, name):
    tag = name.split()[0]
    page = f"<body><nav><a>Home</a></nav><article><h1>Title {{0}}</h1><p>Introduction to {{0}}.</p><{name}><h2>Part of {{0}}</h2><p>{LONG}</p></{tag}><section class=end><p>Conclusion of {{0}}.</p></section></article></body>"
    got = texts(spark, [(i, "h.example", page.format(i)) for i in range(8)] + [(9, "lone.example", page.format(9))])
    for i in (*range(8), 9):
        assert got[i] == [f"Title {i}", f"Introduction to {i}.", f"Part of {i}", LONG.format(i).strip(), f"Conclusion of {i}."]


def test_a_post_without_article_keeps_what_stands_beside_its_body(spark):
    page = f"<body><div class=page><div class=post><h1>Title {{0}}</h1><p>Introduction to {{0}}.</p><div class=entry><p>{LONG}</p></div><p>End of {{0}}.</p></div><div class=right><p>Words on {{0}}</p></div></div></body>"
    hero = f"<body><div class=hero><h1>Title {{0}}</h1></div><div class=entry><p>{LONG}</p></div><div class=right><p>Words on {{0}}</p></div></body>"
    got = texts(spark, [(i, "h.example", page.format(i)) for i in range(6)] + [(i, "g.example", hero.format(i)) for i in range(10, 16)])
    for i in range(6):
        assert got[i] == [f"Title {i}", f"Introduction to {i}.", LONG.format(i).strip(), f"End of {i}."]
        assert got[10 + i] == [f"Title {10 + i}", LONG.format(10 + i).strip()]


@pytest.mark.parametrize("outer", ["div class=discussion", "div class=below"])
@pytest.mark.parametrize("inside", [False, True])
def test_a_discussion_is_no_article(spark, outer, inside):
    item = "<div class=item-{1}><b>Reader {2}</b> <span class=when>on 3 May 2019</span><p>I think that {0} is very good. {3}</p></div>"
    if "below" in outer:
        item = item.replace("</b> ", "</b><br>").replace("<div class=item-{1}>", "<div class=item-{1}><div>").replace("</span>", "</span></div>")
    said = lambda i: "".join(item.format(i, k, "ABC"[k], "And so on and on for a long while. " * 20) for k in range(3))
    article = "<h1>Title {0}</h1><p>The text of {0}, which is short.</p><p>It has two paragraphs, this is {0} too.</p>"
    page = lambda i: f"<body><div class=story>{article.format(i)}</div><{outer}><h3>3 comments</h3>{said(i)}</div></body>"
    if inside:
        page = lambda i: f"<body><article>{article.format(i)}<{outer}><h3>3 comments</h3>{said(i)}</div></article></body>"
    got = texts(spark, [(i, "h.example", page(i)) for i in range(6)] + [(9, "lone.example", page(9))])
    for i in (*range(6), 9):
        assert got[i] == [f"Title {i}", f"The text of {i}, which is short.", f"It has two paragraphs, this is {i} too."]


def test_parts_of_an_article_are_no_comments(spark):
    years = lambda i: "".join(f"<li><p>{1990 + k + 5 * i}</p><p>In that year {i} went to another town.</p></li>" for k in range(4))
    steps = "".join(f"<div class=step><h3>Step {k}</h3><p>Do as {{0}} did in 2019.</p></div>" for k in range(3))
    page = lambda i: f"<body><article><h1>Title {i}</h1><ul>{years(i)}</ul>{steps.format(i)}<p class=byline>By the way, {i} wrote this on 3 May 2019.</p></article></body>"
    got = texts(spark, [(i, "h.example", page(i)) for i in range(5)])
    for i in range(5):
        # steps are the host's own headings, with a text of the page below
        assert got[i] == [f"Title {i}", *(x for k in range(4) for x in (str(1990 + k + 5 * i), f"In that year {i} went to another town.")), *(x for k in range(3) for x in (f"Step {k}", f"Do as {i} did in 2019.")), f"By the way, {i} wrote this on 3 May 2019."]


def test_adverts_and_what_is_not_shown_go_inside_articles_too(spark):
    page = "<body><article><h1>Title {0}</h1><p>First of {0}.</p><p>Buy a mattress today!</p><div style='color:red; display: none'><p>Secret {0}</p></div><p style='visibility:hidden'>Gone {0}</p><h2>Background</h2><p>Last of {0}.</p><h2>Nothing</h2></article></body>"
    got = texts(spark, [(i, "h.example", page.format(i)) for i in range(6)] + [(9, "lone.example", page.format(9))])
    for i in range(6):
        assert got[i] == [f"Title {i}", f"First of {i}.", "Background", f"Last of {i}."]
    assert got[9] == ["Title 9", "First of 9.", "Buy a mattress today!", "Background", "Last of 9.", "Nothing"]


def test_names_that_may_be_a_texts_own(spark):
    sentence = "This part tells how the search for tags was done in {0}, and by whom, and why."
    page = f"<body><article><p>First of {{0}}.</p><div class=tags><p>{sentence}</p></div><div class=tags><a href=x>one {{0}}</a> <a href=y>two {{0}}</a></div><div class=search>Find {{0}}</div></article><div class=more><ul><li><a>Other story number {{0}}</a><li><a>Another story than {{0}}</a><li><a>A third beside {{0}}</a></ul></div></body>"
    got = texts(spark, [(i, "h.example", page.format(i)) for i in range(5)])
    assert all(got[i] == [f"First of {i}.", sentence.format(i)] for i in range(5))


def nested(rng, i, depth=0):
    """Markup and texts of a part of an article."""
    html, out = [], []

    def text(kind):
        out.append(f"{kind} {len(out)} at {depth} of page {i}, {rng.randrange(10**6)}: " + " ".join(rng.choice(["red", "green", "old", "new"]) for _ in range(rng.randrange(1, 30))))
        return out[-1]

    for _ in range(rng.randrange(1, 5)):
        kind = rng.choice(["p", "p", "p", "ul", "quote", "table", *(["deep"] * 3 if depth < 3 else [])])
        if kind == "p":
            html.append(f"<p>{text('Words')}" + rng.choice(["</p>", "</p>\n", ""]))
        elif kind == "ul":
            html.append("<ul>" + "".join(f"<li>{text('Point')}" for _ in range(rng.randrange(1, 4))) + "</ul>")
        elif kind == "quote":
            html.append(f"<blockquote>{text('Quote')}</blockquote>")
        elif kind == "table":
            html.append("<table>" + "".join(f"<tr><td>{text('Cell')}<td>{text('Cell')}" for _ in range(2)) + "</table>")
        else:
            tag = rng.choice(["div", "section"])
            html.append(f"<{tag} class={rng.choice(['part', 'box', 'text'])}><h{depth + 2}>{text('Heading')}</h{depth + 2}>")
            below, said = nested(rng, i, depth + 1)
            html += [below, f"</{tag}>"]
            out += said
    return "".join(html), out


@pytest.mark.parametrize("seed", range(6))
def test_generated_pages(spark, seed):
    rng = random.Random(seed)
    wrap = rng.choice(["<article>{}</article>", "<main><article class=post>{}</article></main>", "<div id=wrap><article>{}</article></div>"])
    advert = "<p>Buy a mattress today!</p>" if seed % 2 else ""
    pages, want = [], {}
    for i in range(12):
        body, said = nested(rng, i)
        comments = "".join(f"<li class=c{k}><span class=user>Ann {k}</span><br><time>2 May 2020, 10:{k}0</time><div><p>Nice page {i}.</p></div></li>" for k in range(rng.randrange(2, 5)))
        side = "<div class=sidebar><p>About us</p></div>" if rng.random() < 0.7 else ""
        top = f"<header><h1>The site</h1></header><nav><a>Home</a></nav><!-- <p>no --><script>if (a<b) x('</p>')</script>{side}"
        article = wrap.format(f"<h1>Title of {i}</h1>{advert}{body}")
        pages.append((i, "h.example", f"<html><body>{top}{article}<div class=below><ol>{comments}</ol></div><footer>end</footer></body></html>"))
        want[i] = [f"Title of {i}", *said]
    got = texts(spark, pages, 3)
    assert {i: [" ".join(x.split()) for x in v] for i, v in want.items()} == got


def test_gaps_do_not_grow_with_the_pages():
    rng = random.Random(1)
    total = None
    for i in range(60):
        extra = "".join(f"<p id=x{rng.randrange(10**9)}>Own {k} of {i}</p>" for k in range(rng.randrange(12)))
        page = wrappers.read(f"<div class=a><h1>T{i}</h1>{extra}<p class=last>End</p></div>")
        w = wrappers.Wrapper(wrappers.stream_items(page), {i}, {})
        if total is None:
            total = w
        else:
            total.merge(w)
    flat = wrappers.written(total.items)
    assert flat.count("<") < 60 and set(wrappers.texts_of(total.items)) == set(wrappers.texts_of(wrappers.stream_items(wrappers.read("<p>End</p>"))))
    assert wrappers.written(wrappers.parsed(flat)) == flat
