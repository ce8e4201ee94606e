from __future__ import annotations

import pytest

from verbarium.llm import html_paths
from verbarium.llm.html_paths import extract, parse, vote

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head>
<body><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy</div>
<div id="cookie-notice">We use cookies</div><article class="post-17"><h1>Title &amp; more</h1>
<p>First  <b>bold</b>
 text.<br>Second line &eacute;.<p>Unclosed &copy paragraph<form><p>Name</p><input></form>
<ul><li>one<li>two</ul><div class="comments"><p>Reader says</p></div></article>
<aside>Side</aside><footer>Foot</footer></body></html>"""
TEXT = "Title & more\nFirst bold text. Second line é.\nUnclosed © paragraph\none\ntwo"


def test_main_text():
    assert extract(PAGE, vote(PAGE)[0]) == TEXT
    assert vote(PAGE)[0] == ">body>article.post"


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("plain text", "plain text"),
        ("<p>a</p><p>b", "a\nb"),
        ("<body><div class=x><p>Some words here</p><div><p>and more of them</p></div></div><div>x</div>", "Some words here\nand more of them"),
        ("<body><main><header><h1>H</h1></header><section><p>one</p></section><section><p>two</p></section></main>", "H\none\ntwo"),
        ("<body><p>a &lt;b&gt; &#233; &unknown; &amp</p>", "a <b> é &unknown; &"),
        ("<body><p>cut <b", "cut"),
        ("<body><div class='menu'><p>all of it is a menu</p></div>", ""),
        ("<p>x</p><textarea><p>no</p></textarea><p>y</p>", "x\ny"),
        ("<table><tr><td>a</div>b<td>c</table>", "a\nb\nc"),
    ],
)
def test_pages(page, text):
    assert extract(page, None) == text


def test_links_count_less_than_prose():
    page = "<body><div class='list'>" + "<p><a href='x'>a link with words</a></p>" * 5 + "</div><div class='text'><p>prose of some words here</p></div></body>"
    assert vote(page)[0] == ">body>div.text"


def test_hosts_agree_on_a_path(spark):
    body = "<body><div class='story'><p>{}</p></div><div class='teasers'><p>{}</p></div></body>"
    rows = [(i, f"http://h.example/{i}", body.format("story " * 20, "teaser")) for i in range(5)]
    # On this page the teasers are longer; the host's path decides.
    rows += [(9, "https://user@H.example:80/x", body.format("short story", "teaser " * 20))]
    rows += [(10, "http://other.example/", "<body><div class='teasers'><p>own</p></div></body>"), (11, None, None), (11, None, "<p>a</p>")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, path string")
    found = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_paths.extract_pages(pages).collect())
    story = ("story " * 20).strip()
    expected = [(i, story, len(story)) for i in range(5)] + [(9, "short story", 11), (10, "own", 3), (11, "", 0), (11, "a", 1)]
    assert found == sorted(expected)


def test_empty_table(spark):
    assert html_paths.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_long_pages():
    page = "<body><article>" + "<p>word</p>" * 20_000 + "<div>" * 3000 + "deep" + "</article>"
    assert extract(page, None).count("\n") == 20_000
    assert len(parse("<" * 5000 + "p>" + "&" * 5000)) >= 1


def test_all_pages_give_their_article(spark):
    import os
    import re

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html_paths.extract_pages(pages).collect():
        page = html[r["page_id"]]
        article = page[page.index("<article>") :].split("</article>")[0]
        words = re.sub(r"<[^>]*>", " ", article)
        from html import unescape

        assert r["text"].split() == unescape(words).split()
        assert r["n_chars"] == len(r["text"])


STORY = "<h1>Title</h1><p>" + "the story has many words " * 20 + "</p>"
WORDS = "Title " + ("the story has many words " * 20).strip()


@pytest.mark.parametrize("wrapper", ["class='has-sidebar'", "class='layout with-menu'", "id='widget-content'", "class='social-page'", "class='widget'", "class='menu'"])
def test_wrappers_named_like_boilerplate_keep_the_article(wrapper):
    for tag in ("article", "main"):
        page = f"<body><div {wrapper}><div class='sidebar'><p>Side</p></div><{tag}>{STORY}</{tag}></div><div class='ad'>Buy</div></body>"
        assert extract(page, vote(page)[0]).split() == WORDS.split()


@pytest.mark.parametrize("wrapper", ["class='has-sidebar'", "class='layout with-menu'", "id='widget-content'", "class='widget'", "class='with-header'"])
def test_wrappers_that_hold_most_of_the_text_stay(wrapper):
    page = f"<body><div {wrapper}>{STORY}<div class='menu'><p>Menu of this page</p></div></div><div class='foot'><p>Foot</p></div></body>"
    assert extract(page, vote(page)[0]).split() == WORDS.split()


def test_names_inside_an_article():
    page = (
        "<body><article><p>one</p><section class='related-work'><p>two</p></section><p class='notice'>three</p><div class='related-posts'><p>no</p></div>"
        "<div class='share-widget-x'><a href='x'>no</a></div><p class='ad'>no</p><div class='comments'><p>no</p></div></article></body>"
    )
    assert extract(page, None) == "one\ntwo\nthree"


def test_small_parts_named_like_boilerplate_go():
    page = f"<body><div class='x'>{STORY}<div class='my-sidebar'><p>no</p></div><div class='comments'><article><p>no</p></article></div></div></body>"
    assert extract(page, vote(page)[0]).split() == WORDS.split()


COMMENT = "<{0} class='comment-body'><p>" + "a reader says a lot here " * 12 + "</p></{0}>"


@pytest.mark.parametrize("count", [1, 3, 6, 20, 200])
@pytest.mark.parametrize("tag", ["article", "div"])
@pytest.mark.parametrize("name", ["class='comments-area'", "id='disqus_thread'", "class='post-comments'", "id='respond'", "class='commentlist'"])
def test_comments_go_whatever_they_hold(count, tag, name):
    comments = f"<div {name}>{COMMENT.format(tag) * count}</div>"
    for page in (
        f"<body><article>{STORY}</article>{comments}</body>",
        f"<body><main>{STORY}</main>{comments}</body>",
        f"<body><main><article>{STORY}</article>{comments}</main></body>",
        f"<body><div class='content'>{STORY}</div>{comments}</body>",
        f"<body>{comments}<article>{STORY}</article></body>",
        f"<body><article>{STORY}</article>{COMMENT.format('article') * count}</body>",
    ):
        assert extract(page, vote(page)[0]) == LINES


LINES = "Title\n" + ("the story has many words " * 20).strip()


@pytest.mark.parametrize("names", [["intro", "details", "summary"], ["", "", ""], ["a", "a", "b"]])
@pytest.mark.parametrize("tag", ["div", "section"])
def test_texts_that_are_split_over_containers_come_out_whole(tag, names):
    parts = ["one two three " * 20, "four five six " * 40, "seven eight " * 10]
    inner = "".join(f"<{tag} class='{n}'><p>{p}</p></{tag}>" for n, p in zip(names, parts, strict=True))
    page = f"<body><div class='top'><a href='x'>a link of the page</a></div><div class='content'>{inner}</div><div class='teasers'><p>teaser</p></div></body>"
    assert extract(page, vote(page)[0]) == "\n".join(p.strip() for p in parts)


def test_text_around_a_quote_and_lead_before_the_body():
    quote = "quoted words " * 60
    page = f"<body><div class='post'><p>Before it.</p><blockquote><p>{quote}</p></blockquote><p>After it.</p></div><div class='x'><p>y</p></div></body>"
    assert extract(page, vote(page)[0]) == f"Before it.\n{quote.strip()}\nAfter it."
    page = f"<body><div class='post'><h1>Title</h1><p>The lead.</p><div class='text'><p>{quote}</p></div></div><div class='x'><p>y</p></div></body>"
    assert extract(page, vote(page)[0]) == f"Title\nThe lead.\n{quote.strip()}"
    page = f"<body><h1>Title</h1><p>The lead.</p><div class='text'><p>{quote}</p></div></body>"
    assert extract(page, vote(page)[0]) == f"Title\nThe lead.\n{quote.strip()}"


def test_lists_of_links_beside_the_text_stay_out():
    links = "<div class='x'>" + "<p><a href='x'>a link with many words in it</a></p>" * 8 + "</div>"
    page = f"<body><div class='page'>{links}<div class='text'>{STORY}</div>{links}</div></body>"
    assert extract(page, vote(page)[0]) == LINES


@pytest.mark.parametrize("unit", ["<div><p>x", "<div class='sidebar'>x", "<ul><li>x", "<div class='a'></p></section>x", "<table><tr><td>x</div>"])
def test_deep_markup_takes_linear_time(unit):
    import time

    def seconds(n: int) -> float:
        start = time.process_time()
        page = "<body>" + unit * n
        extract(page, vote(page)[0])
        return time.process_time() - start

    seconds(1000)
    small, large = seconds(5_000), seconds(50_000)
    assert large < 40 * small + 1


def test_very_deep_markup():
    page = "<body>" + "<div><p>x" * 100_000
    assert extract(page, vote(page)[0]).count("x") == 100_000


def test_blocks_are_joined_by_lines():
    """Against the lines that the pages were made of."""
    import random

    rng = random.Random(4)
    for _ in range(200):
        lines, parts = [], []
        for _ in range(rng.randint(1, 12)):
            words = " ".join(rng.choices(["a", "b&amp;", "<b>c</b>", "d\n", "<a href='x'>e</a>", "&eacute;"], k=rng.randint(1, 9)))
            plain = words.replace("&amp;", "&").replace("&eacute;", "é")
            for mark in ("<b>", "</b>", "<a href='x'>", "</a>"):
                plain = plain.replace(mark, "")
            lines.append(" ".join(plain.split()))
            open_, close = rng.choice([("<p>", "</p>"), ("<p>", ""), ("<h2>", "</h2>"), ("<div>", "</div>"), ("<ul><li>", "</ul>"), ("<blockquote><p>", "</p></blockquote>")])
            parts.append(open_ + words + close + rng.choice(["", "\n  ", "<!-- no -->", "<script>no</script>"]))
        page = f"<body><nav><p>menu</p></nav><article>{''.join(parts)}</article><footer>foot</footer></body>"
        assert extract(page, vote(page)[0]).split("\n") == lines
