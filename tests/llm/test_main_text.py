"""Main text of pages laid out in many ways, of broken and odd pages, and of the pages table against its known template."""

import html
import random
import re
import time

import pytest

from offerlens.llm import main_text as M

PARAGRAPHS = ["The river rose by two metres overnight, and the old bridge, built in 1911, was closed to all traffic at dawn.",
              "Engineers said on Monday that the pillars had held, although the road on the far side was washed away, so repairs will take weeks.",
              "Short one.",
              "A second storm is expected, with less rain, before the weekend; schools & shops in the valley stay open for now."]
TITLE = "Bridge closed after storm"
WANT = "\n\n".join([TITLE, *PARAGRAPHS])
BODY = "".join(f"<p>{html.escape(p)}</p>" for p in PARAGRAPHS)
MENU = "<ul>" + "".join(f'<li><a href="/{w}">{w} news and more</a></li>' for w in ("home", "world", "sport", "money", "travel")) + "</ul>"
COMMENTS = "".join(f'<div class="comment"><p>I think, as a reader, that this is wrong, for many reasons, and I have said so often, in letter {i}.</p></div>' for i in range(9))
COOKIES = '<div class="cookie-notice"><p>We use cookies, and our partners do, to make this site better. Accept?</p></div>'
FORM = '<form action="/s"><p>Subscribe to our letter, it is free, and it comes daily, with all the news.</p><input name="q"><button>Go</button></form>'

PAGES = {
    "article": f"<body><header><h1>Daily</h1></header><nav>{MENU}</nav>{COOKIES}<article><h1>{TITLE}</h1>{BODY}</article><aside><p>Most read, today, this week, this month, and all of last year.</p></aside>{FORM}<footer><p>© Daily</p></footer></body>",
    "divs": f'<body><div id="header"><a href="/">Daily</a></div><div id="menu">{MENU}</div><div id="content"><h1>{TITLE}</h1>{BODY}</div><div id="sidebar"><p>Most read, today, and this week, and last, in all towns.</p></div><div id="footer">Copyright 2020 Daily, all rights reserved</div></body>',
    "no names": f"<body><div>{MENU}</div><div><h1>{TITLE}</h1>{BODY}</div><div>© 2020 Daily. All rights reserved.</div></body>",
    "sections": f"<main><div class='breadcrumb'><a href='/'>Home</a> &gt; <a href='/n'>News</a></div><h1>{TITLE}</h1><section>{''.join(f'<p>{html.escape(p)}</p>' for p in PARAGRAPHS[:2])}</section><section>{''.join(f'<p>{html.escape(p)}</p>' for p in PARAGRAPHS[2:])}</section><section id='comments'><h2>Comments</h2>{COMMENTS}</section></main>",
    "comments outweigh": f"<article><h1>{TITLE}</h1>{BODY}</article><section class='comments'><h3>9 Comments</h3>{COMMENTS * 4}</section>",
    "comments by heading": f"<article><h1>{TITLE}</h1>{BODY}<div><h3>Leave a reply</h3>{COMMENTS.replace('comment', 'x1')}</div></article>",
    "advert inside": f"<article><h1>{TITLE}</h1><div class='ad-slot'>Buy now, pay later, and save.</div>{BODY}<div class='share-buttons'><a href='#'>Share</a></div><ul><li><a href='/a'>Storm in the north, again</a></li><li><a href='/b'>Bridges we lost</a></li><li><a href='/c'>Rain, rain and rain</a></li></ul></article>",
    "scripts": f"<script>var a='<p>not this</p>';if(a<b){{}}</script><style>p>a{{}}</style><article><!-- <p>nor this</p> --><h1>{TITLE}</h1><noscript><p>Turn scripts on, please, for all of it.</p></noscript>{BODY}</article>",
    "header in article": f"<article><header><h1>{TITLE}</h1><p>By A. Writer, yesterday, at noon</p></header>{BODY}<footer>Filed under storms</footer></article>",
    "unclosed": f"<body><div class=nav>{MENU.replace('</li>', '').replace('</a>', '</a>')}</div><article><h1>{TITLE}</h1>" + "".join(f"<p>{html.escape(p)}" for p in PARAGRAPHS) + "</article><footer>end",
    "has-sidebar": f"<body class='has-sidebar no-js'><div class='main-content has-sidebar'><h1>{TITLE}</h1>{BODY}</div><div class='sidebar-right'><p>Tips, tricks, and more, from our experts, for you.</p></div></body>",
    "role": f"<div role='banner'>Daily</div><div role='main'><h1>{TITLE}</h1>{BODY}</div><div role='complementary'>Weather, traffic, tide tables, all day</div>",
    "blank": f"<article>\n  <h1>\n {TITLE[:6]}\t{TITLE[7:]}</h1>\n\n{BODY.replace('. ', '.&nbsp; ').replace(', and', ',<br> and')}\n</article>",
    "hidden": f"<article><h1>{TITLE}</h1><p hidden>Not seen, never, by anyone at all.</p><p style='display: none'>Nor this, ever.</p>{BODY}</article>",
}


@pytest.mark.parametrize("name", list(PAGES))
def test_pages_laid_out_in_many_ways(name):
    assert M.main_text(PAGES[name]) == WANT


def test_odd_pages():
    assert M.main_text(None) == M.main_text("") == M.main_text("<p> &nbsp; </p>") == M.main_text("<script>x") == ""
    assert M.main_text("just a text\nwith two lines") == "just a text with two lines"
    assert M.main_text("<p>1 < 2 &amp;&amp; 3 &gt; 2</p>") == "1 < 2 && 3 > 2"
    assert M.main_text("<article><p>one<p>two</b></i></div><p>three") == "one\n\ntwo\n\nthree"
    assert M.main_text("<article><table><tr><td>a<td>b<tr><td>c</table><p>d</article>") == "a\n\nb\n\nc\n\nd"
    assert M.main_text("<article><p title='a>b' data-x=\"<p>\">quoted</p><p>x</p></article>") == "quoted\n\nx"
    assert M.main_text("<article><p>cut off <a href=\"") == "cut off"


@pytest.mark.parametrize("piece", ["<div>", "<b>", "<p>x", "</div>", "<!--", "<", "<a \"", "<a '\">", "&amp;", "<ul><li>x", "<script>", "<h2>Comments</h2><div>x"])
def test_very_long_odd_pages_take_linear_time(piece):
    start = time.time()
    M.main_text("<article>" + piece * 60_000 + "<p>end of it")
    assert time.time() - start < 20


def test_pages_table_equals_its_template(spark):
    from offerlens.llm.queries import QUERIES
    folder = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = QUERIES["op13_main_text"](spark, folder).collect()
    assert len(got) == len(pages)
    for r in got:
        body = re.search(r"<article>(.*?)(?:</article>|<footer|$)", pages[r.page_id].html, re.S).group(1)
        parts = [" ".join(html.unescape(re.sub("<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(filter(None, parts)) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_nulls_repeats_and_clashing_names(spark):
    rnd = random.Random(1)
    rows = [(1, "u", "<p>a</p>", "k", "u2", "t", "h"), (1, "u", "<p>a</p>", "k", "u2", "t", "h"), (None, None, None, None, None, None, None), (2, None, "", "", "", "", ""),
            (3, "v", "<article>" + "".join(f"<p>{rnd.random()} words, more words</p>" for _ in range(20_000)) + "</article>", "", "", "", "")]
    schema = "page_id bigint, url string, html string, k string, u string, text string, h string"
    got = M.extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r.page_id), str(r.url), r.n_chars) for r in got if r.page_id != 3) == [("1", "u", 1), ("1", "u", 1), ("2", "None", 0), ("None", "None", 0)]
    assert next(r for r in got if r.page_id == 3).text.count("\n\n") == 19_999
    assert M.extract(spark.createDataFrame([], schema)).count() == 0
