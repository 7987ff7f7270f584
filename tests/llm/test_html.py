from __future__ import annotations

import html
import re

import pytest

from speechmill.llm import html_text as ht

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><article>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="wrap"><aside>side</aside>{main}<section class="comments"><p>first! {n}</p><p>second {n}</p></section><form><label>Mail</label></form></div>
<footer>&copy; me {n}</footer></body></html>"""


def page(n: int, main: str) -> str:
    return PAGE.format(n=n, main=main)


def test_articles_without_what_surrounds_them():
    pages = [page(n, f"<article><h1>Head {n}</h1><p>One &amp; two\n  {n}</p><p><b>Three<br>3 {n}<p>Four{' <i>x</i>y' * n}</p><div class='share'>Share</div></article>") for n in range(4)]
    w = ht.infer(pages)
    for n, p in enumerate(pages):
        assert ht.extract(p, w) == f"Head {n}\n\nOne & two {n}\n\nThree 3 {n}\n\nFour{' xy' * n}"
    assert "+" in w["expression"] and "?" in w["expression"] and "|" not in w["expression"] and "#TEXT" in w["expression"]


def bare(n: int, more: str = "") -> str:
    return f"<html><body><div class='top'>The Site</div><div class='x'><a href=1>One</a> <a href=2>Two</a></div><div class='body'><div class='inner'><h2>Title {n}</h2><p>{'word ' * (20 + n)}{n}</p><p>{'more ' * 9}{more}</p></div></div><div class='y'>All rights reserved</div></body></html>"


@pytest.mark.parametrize("n_pages", [2, 3, 9])
def test_main_element_without_a_name_by_what_the_pages_agree_on(n_pages):
    pages = [bare(n) for n in range(n_pages)]
    w = ht.infer(pages)
    assert not w["named"]
    for n, p in enumerate(pages):
        assert ht.extract(p, w) == f"Title {n}\n\n" + " ".join(["word"] * (20 + n)) + f" {n}\n\n" + " ".join(["more"] * 9)


def test_one_page_alone_shows_links_only():
    text = ht.extract(bare(0), ht.infer([bare(0)]))
    assert "Title 0" in text and "One" not in text


def test_copies_of_an_article_do_not_lose_it():
    """Pages that agree in all but an advert agree in the article, not in the site."""
    pages = [bare(1).replace("</body>", f"<p>Buy now {n}</p></body>") for n in range(5)]
    w = ht.infer(pages)
    for p in pages:
        assert "Title 1\n\nword word" in ht.extract(p, w)
    pages = [page(n, "<article><h1>Same head</h1><p>Same text</p></article>") for n in range(5)]
    assert {ht.extract(p, ht.infer(pages)) for p in pages} == {"Same head\n\nSame text"}


def test_parts_of_an_article_stay_whatever_they_are_named():
    inside = "<h1>H</h1><figure><img src=x><figcaption>Caption</figcaption></figure><section class='related work'><p>Work</p></section><div id='search'>Trees</div><div class='footer'>Note</div>"
    links = "<div class='related'><a>One</a><a>Two</a></div><ul class='share'><li><a>x</a></li></ul><div class='comments-area'><p>No!</p></div><div class='cookie-notice'>Ok?</div><div class='ad-slot'>Buy</div>"
    p = f"<html><body><main><article>{inside}{links}</article></main></body></html>"
    for others in ([], [p.replace("Work", "Werk").replace("Trees", "Bäume").replace("Note", "Notiz").replace("Caption", "Bild")]):
        assert ht.extract(p, ht.infer([p, *others])) == "H\n\nCaption\n\nWork\n\nTrees\n\nNote"


def test_a_heading_beside_the_article_stays():
    p = f"<body><main><h1>Title</h1><article><p>{'text ' * 40}</p></article><section class='comments'><p>no</p></section></main></body>"
    assert ht.extract(p, ht.infer([p])) == "Title\n\n" + " ".join(["text"] * 40)


def test_what_the_sample_does_not_foresee_is_read():
    sample = [page(n, f"<article><h1>Head {n}</h1><p>Text {n}</p></article>") for n in range(3)]
    new = page(7, "<article><h1>Head</h1><blockquote><p>Quote</p></blockquote><p>Text</p><div class='comments'>no</div><table><tr><td>1<td>2</table></article>")
    assert ht.extract(new, ht.infer(sample)) == "Head\n\nQuote\n\nText\n\n1\n\n2"
    other = "<body><section><main><p>Elsewhere</p></main></section></body>"
    assert ht.extract(other, ht.infer(sample)) == "Elsewhere"


@pytest.mark.parametrize("opening,closing", [("<div>", "</div>"), ("<span>", ""), ("<b><div>", ""), ("<ul><li>", "")])
def test_deep_pages(opening, closing):
    for n in (1200, 5000):
        p = "<html><body><article><h1>Top</h1>" + opening * n + "deep" + closing * n + "</article></body></html>"
        for pages in ([p], [p, p.replace("deep", "deeper")]):
            assert ht.extract(p, ht.infer(pages)) == "Top\n\ndeep"


def test_long_lists_of_unlike_children():
    p = "<article>" + "".join(f"<h2>h {k}</h2><p class='c{k % 50}'>p {k}</p>" for k in range(4000)) + "</article>"
    q = p.replace("c7", "c8")
    text = ht.extract(p, ht.infer([p, q]))
    assert text == "\n\n".join(f"h {k}\n\np {k}" for k in range(4000))


def test_optional_and_repeated_groups():
    w = ht.generalise(ht.parse("<ul><li>a</li><li><b>b</b></li></ul>"))
    assert ht.expression(w) == '<ul>(<li>("a")?(<b>"b"</b>)?</li>)+</ul>'
    two = ht.align(ht.generalise(ht.parse("<p>x</p><hr>")), ht.generalise(ht.parse("<p>y</p>")))
    assert ht.expression(two) == "<p>#TEXT</p>(<hr></hr>)?"
    assert ht.matches(list("abcxd"), list("abyycd")) == [(0, 0), (1, 1), (2, 4), (4, 5)]


@pytest.mark.parametrize("text", ["", "plain", "<", "<p", "<p>a", "<article>", "</p></div>", "<!-- <p>x</p>", "<script>x", "<article><p>a<p>b</article", "<article>&lt;b&gt; &#65;&nbsp;c</article>"])
def test_broken_pages(text):
    assert isinstance(ht.extract(text, ht.infer([text])), str)
    assert ht.extract(None, None) == ""


def test_references_and_spaces():
    assert ht.extract("<article>&lt;b&gt; &#65;&nbsp;c \n d<br>e</article>", None) == "<b> A c d e"


PAGES = "page_id long, url string, html string"


def test_query_on_awkward_tables(spark, tmp_path):
    data = [(1, "http://a.b/c", page(1, "<article><p>x 1</p></article>")), (1, "http://a.b/c", page(1, "<article><p>x 1</p></article>")), (2, None, page(2, "<article><p>y 2</p></article>")), (3, "nonsense", None), (4, "http://a.b", ""), (None, "http://a.b/d", page(3, "<article><p>z " + "long " * 30000 + "</p></article>"))]
    df = spark.createDataFrame(data, PAGES)
    df.write.parquet(f"{tmp_path}/pages.parquet")
    out = sorted(((r["page_id"], r["text"][:3], r["n_chars"]) for r in ht.op6_html_text(spark, str(tmp_path)).collect()), key=str)
    assert out == sorted([(1, "x 1", 3), (1, "x 1", 3), (2, "y 2", 3), (3, "", 0), (4, "", 0), (None, "z l", 150001)], key=str)
    assert ht.main_text(df.where("false")).count() == 0
    clash = ht.main_text(df.selectExpr("*", "1 as wrapper", "2 as HOST", "3 as Text", "4 as keep"))
    assert sorted(clash.columns) == ["html", "keep", "page_id", "text", "url"]


def test_query_equals_a_plain_reading(spark, sf_dir):
    for r in ht.op6_html_text(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inside = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub("</?b>", "", p).replace("<br>", " "))).strip() for p in re.split("</?(?:p|h1)>", inside)]
        assert r["text"] == "\n\n".join(p for p in parts if p)


@pytest.mark.parametrize("body", ["class='single no-sidebar'", "class='header'"])
def test_names_that_only_contain_a_word_of_asides_keep_their_text(body):
    inside = "<h2 id='search-algorithms'>Head</h2><section id='related-work'><p>One</p></section><div id='social-history'>Two</div><figure><figcaption>Three</figcaption></figure><div class='cookie-notice'>no</div>"
    p = f"<html><body {body}><div class='content with-sidebar'><article class='post comments-open'>{inside}</article></div><div class='sidebar'>no</div></body></html>"
    assert ht.extract(p, ht.infer([p])) == "Head\n\nOne\n\nTwo\n\nThree"


def test_no_part_of_an_article_is_left_outside():
    p = f"<html><body><nav>menu</nav><div id=page><h1>Title</h1><div class=lead>Lead</div><div class=body>{'word ' * 50}</div></div><footer>foot</footer></body></html>"
    assert ht.extract(p, ht.infer([p])) == "Title\n\nLead\n\n" + " ".join(["word"] * 50)
    p = f"<body><div><article><p>{'one ' * 9}</p></article><aside>x</aside><article><p>{'two ' * 9}</p></article></div></body>"
    assert ht.extract(p, ht.infer([p])) == " ".join(["one"] * 9) + "\n\n" + " ".join(["two"] * 9)
