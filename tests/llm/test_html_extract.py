import random
import time

from termforge.llm import html_extract as H


def test_article_without_what_is_around():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x = "<p>no</p>";</script></head><body>
    <header><a href="/">Home</a></header><nav><ul><li><a href="/a">News</a></li></ul></nav>
    <div class="cookie-notice">We use cookies</div>
    <article><h1>Head&nbsp;line &amp; more</h1><p>First   para&shy;graph with <b>bold</b>ness.</p>
    <div class="ad">Buy now</div><p>Second<br>line &#233;&#x1F600;.</p><ul><li>one</li><li>two</li></ul></article>
    <aside><p>Side words here</p></aside><form><label>Mail</label><input></form>
    <section class="comments"><p>I disagree strongly with everything said</p></section><footer>&copy; 2024 Us</footer></body></html>"""
    assert H.extractor().text(page) == "Head line & more First para\xadgraph with boldness. Second line \xe9\U0001f600. one two"


def test_best_run_against_brute_force():
    r = random.Random(3)
    for _ in range(500):
        scores = [r.randint(-4, 4) for _ in range(r.randint(0, 25))]
        a, b = H.best_run([float(s) for s in scores])
        every = [sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1)]
        assert sum(scores[a:b]) == max([0, *every])


def test_labelled_pages_it_has_not_seen():
    """Held-out made-up pages: the region is the labelled element."""
    e, right, total = H.extractor(), 0, 0
    for page, content in H.labelled_pages(150, seed=77):
        tokens, elements = H.parsed(page)
        out = H._left_out(tokens, elements)
        found = elements[e.region(tokens, elements, out)]
        total += 1
        right += found.name == content
    assert right >= 0.93 * total


def test_broken_markup_does_not_fail():
    r = random.Random(5)
    bits = ["<p>", "</p>", "<div class='ad", "<", ">", "&amp", "&#xZZ;", "<!--", "-->", "<script>", "text words", "<a href=\"", "'", "</", "<li>", "<nav>", "<article>", "\x00", "é", "<td", "/>"]
    for _ in range(500):
        text = H.extractor().text("".join(r.choice(bits) for _ in range(r.randint(0, 40))))
        assert text == " ".join(text.split())


def test_edges(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "plain words"), (4, "v", "<p>a</p><p>b</p>"), (4, "v", "<p>a</p><p>b</p>"), (5, "w", "<p>" + "long words " * 100_000 + "</p>"), (6, "x", "<nav>only menu</nav>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "9 AS n_chars", "'t' AS text")
    found = sorted((r["page_id"], r["text"], r["n_chars"]) for r in H.extract_main_text(pages).collect())
    assert found[:6] == [(1, "", 0), (2, "", 0), (3, "plain words", 11), (4, "a b", 3), (4, "a b", 3), (5, ("long words " * 100_000).strip(), 1_099_999)]
    assert H.extract_main_text(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


def test_whole_table(spark, small):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    found = {r["page_id"]: r for r in H.op6_html_extraction(spark, small).collect()}
    assert set(found) == set(pages)
    for i, r in found.items():
        assert r["url"] == pages[i]["url"] and r["n_chars"] == len(r["text"]) and "  " not in r["text"]


def test_no_part_of_a_nested_article_is_lost():
    long, ads = f"<p>{'word other words here ' * 100}</p>", "<p><a href='x'>buy</a></p>" * 60
    for page, ends in (
        (f"<body><article><h1>Title of it</h1><p>lede lines</p><div class='content'>{long}</div></article></body>", ("Title of it lede lines word", "words here")),
        (f"<body><article><section>{long}</section><section><h2>Close</h2><p>closing words of the text</p></section></article></body>", ("word other", "Close closing words of the text")),
        (f"<body><article><section><p>{'first words ' * 40}</p></section><div class='ad'>{ads}</div><section><p>{'second words ' * 40}</p></section></article></body>", ("first words", "second words")),
    ):
        text = H.extractor().text(page)
        assert text.startswith(ends[0]) and text.endswith(ends[1]) and "buy" not in text


def test_ids_and_names_inside_the_article():
    page = "<body><div class='comments-box'>no</div><article><h2 id='search'>Search</h2><p>find it</p><h2 id='comments-on-method'>Method</h2><section id='related-work'><p class='alert'>take care</p></section><p>foo<img src=x>bar</p><div id='comments'>I agree</div></article></body>"
    assert H.extractor().text(page) == "Search find it Method take care foobar"


def test_closing_tags_that_match_nothing_cost_their_length():
    began = time.time()
    for page in ("<div>" * 50_000 + "</b>" * 100_000 + "words here", "<nav>" + "<i>" * 20_000 + "<article>" * 20_000 + "words here", "<article>" + "<span></nope>" * 50_000 + "words here"):
        assert H.extractor().text(page).endswith("words here")
    assert time.time() - began < 20


def test_gold_texts_of_pages_without_article():
    """Made-up pages whose main text is known word for word, in a plain div, with two sections and a picture in it."""
    r = random.Random(6)
    words = lambda k: " ".join(r.choice(("iron", "lake", "stone", "north", "river", "quiet")) for _ in range(k))
    for _ in range(60):
        parts = [words(r.randint(3, 8)), *(words(r.randint(15, 70)) for _ in range(r.randint(3, 8)))]
        inner = f"<h1 id='menu'>{parts[0]}</h1>" + "".join(f"<section><p>{p[: len(p) // 2]}<img src=y>{p[len(p) // 2 :]}</p></section>" for p in parts[1:])
        around = "".join(f"<li><a href='/{i}'>{words(2)}</a></li>" for i in range(12))
        page = f"<html><body><nav><ul>{around}</ul></nav><div><div>{inner}<div class='ad'>{words(20)}</div></div></div><div class='sidebar'>{words(30)}</div><ul>{around}</ul><footer>{words(9)}</footer></body></html>"
        assert H.extractor().text(page) == " ".join(parts)
