from __future__ import annotations

import time

import brute
import pytest
from compare import difference, duck

from siftwall.llm import html_text, queries
from siftwall.llm.html_text import main_text

LONG = "A sentence that is long enough to count as running text, with commas and all. " * 3
P = LONG.strip()


@pytest.mark.parametrize("name", list(queries.SQL))
def test_queries_equal_their_sql(spark, name):
    found = queries.QUERIES[name](spark, brute.SMALL)
    assert difference(found, duck(brute.SMALL).sql(queries.SQL[name])) is None


PAGES = {
    "marked article, title kept": (
        f"<body><header><h1>Site</h1></header><nav><a href=/>x</a></nav><article><h1>T</h1><p>{P}</p><p>End.</p>"
        f"</article><aside>{P}</aside><footer>(c) {P}</footer></body>",
        f"T\n{P}\nEnd.",
    ),
    "no marks, blocks in one division": (
        "<div><a href=1>Home</a> <a href=2>News</a></div><div id=main><h1>T</h1><p>Short.</p>"
        f"<p>{P}</p><p>{P}</p><p>Bye.</p></div><div>(c) Someone</div>",
        f"T\nShort.\n{P}\n{P}\nBye.",
    ),
    "sections of one division": (
        f"<div class=top>Menu</div><div class=x><div><p>{P}</p></div><div><p>{P}</p></div><div><p>Fin.</p></div>"
        "</div><div>Some address</div>",
        f"{P}\n{P}\nFin.",
    ),
    "comments, adverts and forms inside": (
        f"<main><article><h2>T</h2><p>{P}</p><div class='ad-slot'>{P}</div><form><p>{P}</p></form><p>Z</p>"
        f"<section id=comments><h3>2 replies</h3><article class=c><p>{P}</p></article></section></article></main>",
        f"T\n{P}\nZ",
    ),
    "articles as remarks": (
        f"<article><p>One {P}</p><article><p>{P} {P} {P}</p></article></article>",
        f"One {P}",
    ),
    "heaviest of several": (f"<article><p>a b</p></article><article><p>{P}</p></article>", P),
    "names that only sound like a wall": (
        f"<body class='has-sidebar no-comments'><div class='article-header'><h1>T</h1></div><div><p>{P}</p></div></body>",
        f"T\n{P}",
    ),
    "article within a block named like a widget": (f"<div class=widget><article><p>{P}</p></article></div>", P),
    "notices and hidden text": (
        f"<div class='cookie-notice'>{P}</div><article><p>{P}</p><p style='display: none'>x</p><p hidden>y</p></article>",
        P,
    ),
    "references and white space": (
        "<article><p> a&nbsp;&amp;\n\t b &#233;&lt;b&gt; &amp;amp; &bogus; </p><p>x<br>y<b>z</b>w</p></article>",
        "a & b é<b> &amp; &bogus;\nx yzw",
    ),
    "scripts, styles, remarks, odd tags": (
        "<article><script>if (a<b) '</p><p>no'</script><style>p{}</style><!-- <p>no</p> --><p title='a>b'>yes"
        "<p>1 < 2 <unknown>z</unknown><textarea>no</textarea></article><script>open",
        "yes\n1 < 2 z",
    ),
    "lists, tables, links inside": (
        f"<article><h1><a href=1>T</a></h1><p>{P}</p><ul><li>one<li>two</ul><table><tr><td>a<td>b</table>"
        f"<p><a href=2>link</a></p></article>",
        f"T\n{P}\none\ntwo\na\nb\nlink",
    ),
    "only links": ("<nav>x</nav><div><a href=1>a</a><a href=2>b</a></div>", ""),
    "nothing": ("<html><body></body></html>", ""),
    "plain text": ("just words", "just words"),
    "unclosed": (f"<article><p><b>{P}<p>next", f"{P}\nnext"),
    "empty": ("", ""),
    "null": (None, ""),
}


@pytest.mark.parametrize("name", list(PAGES))
def test_pages(name):
    page, text = PAGES[name]
    assert main_text(page) == text


def test_rows(spark):
    rows = [(k, name, PAGES[name][0], "n", 7) for k, name in enumerate(PAGES)]
    rows += [(0, None, PAGES["unclosed"][0], None, None), (None, "u", "<p>" + "word " * 400_000 + "</p>", "", 1)]
    schema = "page_id long, url string, html string, text string, id int"
    got = html_text.extract_pages(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows)
    by_url = {r.url: r for r in got}
    for name, (_, text) in PAGES.items():
        assert (by_url[name].text, by_url[name].n_chars) == (text, len(text))
    assert by_url["u"].id is None and by_url["u"].n_chars == 5 * 400_000 - 1
    assert sorted(r.id for r in got if r.id is not None)[:2] == [0, 0]
    empty = spark.createDataFrame([], "page_id long, html string")
    assert html_text.extract_pages(empty).collect() == []


@pytest.mark.parametrize("piece", ['<a "', "<div>", "</p>", "<p><b>", '="', "<!--", "<script>", "&amp", "<article>"])
def test_linear_time(piece):
    start = time.time()
    main_text(piece * 50_000)
    assert time.time() - start < 10
