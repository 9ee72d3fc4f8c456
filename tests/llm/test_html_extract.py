import html
import re

import pytest

from llm.helpers import SMALL
from tillbook.llm.html_extract import extract_pages, main_text

PROSE = ("It was not the first time that they had been to the house by the river, and it would not be the last, for the "
         "garden was open to all of them and the road from the town is short.")
SCHEMA = "page_id long, url string, html string, text string, n_chars int"


def between_tags(page):
    """The article of the test pages, read off its known frame."""
    body = re.search("<article>(.*?)</article>", page, re.S).group(1)
    parts = [" ".join(html.unescape(re.sub("</?b>", "", p).replace("<br>", " ")).split()) for p in re.split("</?(?:p|h1)>", body)]
    return "\n".join(p for p in parts if p)


def test_pages_of_the_table(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in extract_pages(pages).collect()}
    for r in pages.collect():
        want = between_tags(r.html)
        assert got[r.page_id] == (want, len(want))


@pytest.mark.parametrize("beside", [
    "<nav><ul><li><a href=/>Home</a></ul></nav>", "<header><p>Site</header>", "<footer>&copy; 2024 " + PROSE + "</footer>",
    "<aside>" + PROSE + "</aside>", '<div class="cookie-notice">' + PROSE + "</div>", '<div id=sidebar><p>' + PROSE + "</div>",
    '<div class="ad">' + PROSE + "</div>", "<form><label>Your name</label><input name=n></form>", "<script>var a = '<p>" + PROSE + "';</script>",
    "<style>p > b { color: red }</style>", "<!-- " + PROSE + " -->", '<section class="comments"><h2>Comments</h2><p>' + PROSE + "</section>",
    '<ul><li><a href=a>' + PROSE + "</a></ul>", '<div style="display: none">' + PROSE + "</div>", "<noscript>" + PROSE + "</noscript>",
    '<div role="banner">' + PROSE + "</div>", '<article class="comment">' + PROSE + "</article>"])
def test_what_stands_beside_an_article(beside):
    kept = f"Title\n{PROSE}\nA short end."
    inner = f"<h1>Title</h1><p>{PROSE}</p><p>A short end.</p>"
    for frame in ("<body>{0}<article>{1}</article>{0}</body>", "<body>{0}<main>{1}{0}</main></body>", "<body><div>{1}</div>{0}</body>"):
        assert main_text(frame.format(beside, inner)) == kept, frame


def test_references_white_space_and_inline_markup():
    page = "<article><p>a&nbsp;&amp;\n\t b&#x41;&eacute;<b>c</b>d e<br>f &lt;g&gt; 1 < 2 &notaref; x</p></article>"
    assert main_text(page) == "a & bAécd e f <g> 1 < 2 ¬aref; x"
    assert main_text("<article>one<br><br>two<hr>three</article>") == "one\ntwo\nthree"


def test_short_blocks_inherit_from_the_nearest_decided_block():
    page = f"<body><div>Menu</div><ul><li><a href=1>One link here</a><li><a href=2>Two</a></ul><h2>Head</h2><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p></body>"
    assert main_text(page) == f"Head\n{PROSE}\nShort.\n{PROSE}"


def test_text_without_known_stop_words_is_kept_whole():
    words = "蔵 " * 60
    assert main_text(f"<body><nav><a href=1>m</a></nav><p>{words}</p></body>") == " ".join(words.split())
    assert main_text("<article><p>Tak%%% ano&amp;&amp;&amp;</p></article>") == "Tak%%% ano&&&"


def test_broken_markup():
    assert main_text("<article><p>one<p>two<li>three<li>four") == "one\ntwo\nthree\nfour"
    assert main_text("<article><p>cut</p><p>text &am") == "cut\ntext &am"
    assert main_text("<article><p>cut</p><p class='x") == "cut"
    assert main_text("<article><p title='it>s'>quoted</p></div></article></nav>") == "quoted"
    assert main_text("<article><p>x</p><script>never closed <p>y") == "x"
    assert main_text("<article><p>x<!-- never closed <p>y") == "x"
    assert main_text('<body class="has-sidebar"><div class="with-sidebar"><article>kept</article></div>') == "kept"


def test_nulls_empty_long_and_repeated_pages(spark):
    long_page = "<article>" + f"<p>{PROSE}</p>" * 20_000 + "</article>"
    rows = [(1, "u", None, "t", 1), (2, None, "", "t", 1), (None, "u", "<article>x</article>", "t", 1), (3, "u", long_page, "t", 1),
            (4, "u", "<p> \n </p>", "t", 1), (4, "u", "<p> \n </p>", "t", 1)]
    got = sorted(((r.page_id or 0, r.url, len(r.text), r.n_chars) for r in extract_pages(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    size = 20_000 * (len(PROSE) + 1) - 1
    assert got == sorted([(1, "u", 0, 0), (2, None, 0, 0), (0, "u", 1, 1), (3, "u", size, size), (4, "u", 0, 0), (4, "u", 0, 0)], key=str)
    assert extract_pages(spark.createDataFrame([], SCHEMA)).collect() == []
