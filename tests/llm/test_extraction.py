"""Template deduction and extraction on small hosts of several shapes, and on awkward pages."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from daybook.llm import extraction, markup

PAGE = "page_id long, url string, html string"
WORDS = "amber birch cedar delta ember fjord grove heath inlet jetty knoll larch".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def extracted(spark, rows):
    got = extraction.extract(spark.createDataFrame(rows, PAGE)).collect()
    return {r.page_id: r.text for r in got}


def marked(rng, i):
    """A page with an article among other parts, and its text."""
    title, first, second = prose(rng, 4), prose(rng, 30), prose(rng, 9)
    html = f"""<!doctype html><html><head><title>{title}</title><script>if (a</p>b) x = "<article>";</script></head>
      <body class="has-sidebar"><header><h2>Site</h2></header><nav><ul><li><a href=/x?id=ad>{prose(rng, 1)}</a><li>b</ul></nav>
      <div class="cookie-notice">We use <b>cookies</b></div><!-- {prose(rng, 3)} --><aside>{prose(rng, 5)}</aside>
      <article class="post"><header><h1>{title}</h1></header><p>{first}<br>R&amp;D &lt; 3&nbsp;&euro;<p>on<b>e</b> two
      <div class="ad-box">Buy {prose(rng, 3)}</div><form><input value="x">Send</form>
      <ul><li>{second}</ul><section id="comments"><p>Nice {prose(rng, 4)}</p></section></article>
      <footer>&copy; {prose(rng, 2)}</footer>"""
    return html + ("</body></html>" if i % 3 else ""), f"{title} {first} R&D < 3 € one two {second}"


def test_articles_are_taken_whole_and_alone(spark):
    rng = random.Random(1)
    pages = [marked(rng, i) for i in range(12)]
    rows = [(i, f"https://Host.example/{i}", html) for i, (html, _) in enumerate(pages)]
    rows += [(50, "http://lone.example", pages[0][0])]
    got = extracted(spark, rows)
    assert got == {i: text for i, (_, text) in enumerate(pages)} | {50: pages[0][1]}


def test_alike_articles_stay(spark):
    html, text = marked(random.Random(2), 1)
    got = extracted(spark, [(i, "http://a.example/", html) for i in range(6)])
    assert set(got.values()) == {text}


def unmarked(rng, i):
    """A page whose parts only the other pages of the host tell apart."""
    body = f"{prose(rng, 12)} {i}"
    links = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in rng.sample(WORDS, 4))
    extra = f"<p>{prose(rng, 6)}</p>" if i % 2 else ""
    html = f"""<html><body><div id=t><b>My Site</b> since 1999</div><div id=l><ul>{links}</ul></div>
      <div id=c><h2>Post {i}</h2><p>{body}</p>{extra}</div><div id=e>All rights kept</div></body></html>"""
    tail = f" {extra[3:-4]}" if extra else ""
    return html, f"Post {i} {body}{tail}"


def test_template_alone_separates_unmarked_pages(spark):
    rng = random.Random(4)
    pages = [unmarked(rng, i) for i in range(20)]
    got = extracted(spark, [(i, f"http://b.example/{i}", html) for i, (html, _) in enumerate(pages)])
    assert got == {i: text for i, (_, text) in enumerate(pages)}


def test_template_finds_the_slot_where_a_page_lacks_its_mark(spark):
    rows = [(i, "http://c.example", f"<body><div id=h>Top {i}</div><main><h1>T{i}</h1><p>words {i}</p></main></body>") for i in range(9)]
    rows += [(9, "http://c.example", "<body><div id=h>Top 9</div><p>stray</p></body>")]
    got = extracted(spark, rows)
    assert got == {i: f"T{i} words {i}" for i in range(9)} | {9: ""}


def test_classes_hold_exactly_tokens_with_equal_vectors(spark):
    rng = random.Random(6)
    texts = {i: unmarked(rng, i)[0] for i in range(15)}
    rows = [(f"h{i % 2}", i, html) for i, html in texts.items()]
    found = extraction.candidates(spark.createDataFrame(rows, "host string, mark long, html string")).collect()
    for name in ("h0", "h1"):
        mine = [html for h, _, html in rows if h == name]
        counts = [Counter(t.key for t in markup.tokens(html) if t.key) for html in mine]
        vectors = {}
        for key in set().union(*counts):
            vector = tuple(c[key] for c in counts)
            if 2 * sum(n > 0 for n in vector) >= len(mine):
                vectors.setdefault(vector, set()).add(key)
        want = {frozenset(keys) for keys in vectors.values() if len(keys) > 1}
        assert {frozenset(r["keys"]) for r in found if r.host == name} == want


def test_check_of_order_and_nesting():
    sizes = Counter({1: 2, 2: 2})
    good = extraction.check_classes([(1, 10), (2, 20), (2, 21), (2, 20), (2, 21), (1, 11)], sizes)
    assert good[1][0] and good[2][0]
    crossed = extraction.check_classes([(1, 10), (2, 20), (1, 11), (2, 21)], sizes)
    assert not crossed[2][0]
    turned = extraction.check_classes([(2, 20), (2, 21), (2, 21), (2, 20)], sizes)
    assert not turned[2][0]


@pytest.mark.parametrize("html", [None, "", "   ", "<", "<p", "</p>", "<!--", "<script>x", "a < b &am &amp", "<a b='>"])
def test_awkward_pages(spark, html):
    want = {"a < b &am &amp": "a < b &am &", "<": "<"}.get(html, "")
    assert extracted(spark, [(1, None, html), (2, "no url", html)]) == {1: want, 2: want}


def test_long_pages_repeated_rows_clashing_columns_and_no_pages(spark):
    deep = "<div>" * 3000 + "<article>" + "word " * 100_000 + "</article>"
    rows = [(1, "http://d.example", deep)] * 3 + [(None, "http://d.example", "<article>x</article>")]
    pages = spark.createDataFrame(rows, PAGE).withColumns({"text": F.lit(1), "host": F.lit(2), "marks": F.lit(3)})
    got = extraction.extract(pages).collect()
    assert Counter(len(r.text) for r in got) == {499_999: 3, 1: 1}
    assert extraction.extract(spark.createDataFrame([], PAGE)).collect() == []
