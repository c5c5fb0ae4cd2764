from ticketlake.llm import htmltext as H
from ticketlake.llm.queries import QUERIES

from .conftest import SF001

NAV = "<nav><ul>" + "".join(f'<li><a href="/{i}">Menu {i}</a></li>' for i in range(8)) + "</ul></nav>"


def page(body, main='<div class="post p12">{}</div>'):
    return ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p><p>no';</script></head><body>" + NAV
            + '<div class="ad">Buy now and save a lot of money today</div>' + main.format(body)
            + '<aside>about me</aside><footer>&copy; site</footer></body></html>')


def test_blocks_entities_and_noise():
    body = ("<h1>Title &amp; more</h1><p>First  <b>bold</b>\n text<br>goes on &lt;here&gt; caf&eacute; &#8364;5<p>Second"
            "<!-- hidden > --><form><p>Name</p><input></form><ul><li>one</li><li><a href='x>y'>two</a></li></ul>"
            '<div class="comments"><p>First!</p></div><div class="cookie-notice">We use cookies</div>')
    assert H.main_text(page(body), []) == "Title & more\n\nFirst bold text goes on <here> café €5\n\nSecond\n\none\n\ntwo"


def test_unclosed_and_odd_input():
    assert H.main_text(None, []) == "" and H.main_text("", []) == ""
    assert H.main_text("plain words only", []) == "plain words only"
    assert H.main_text("<body><p>a<script>never closed <p>b", []) == "a"
    assert H.main_text("<p>a <!-- never closed <p>b", []) == "a"
    assert H.main_text("x < y and 1 <2 <b>z</b>", []) == "x < y and 1 <2 z"
    assert H.main_text("<div class='sidebar-page comments'><p>All of it</p></div>", []) == "All of it"
    H.main_text("<a title=\"" * 3000 + "<div>" * 3000 + "x", [])


def test_host_consensus_beats_a_misleading_page(spark):
    article = "<p>" + "real words of the article, and more of them. " * 12 + "</p>"
    other = '<div class="box9">' + "<p>" + "other text that runs very long indeed. " * 60 + "</p></div>"
    rows = [(i, f"http://H.example.org/{i}", page(article) if i else page("<p>short article</p>") + other) for i in range(6)]
    rows += [(10, None, None), (11, "nonsense", ""), (12, "http://h.example.org/12", page(article)), (12, "http://h.example.org/12", page(article))]
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], "page_id long, url string, html string, host string, ranked string")
    got = {r.page_id: r for r in H.extract_pages(df).collect()}
    assert len(got) == 9 and H.extract_pages(df).count() == 10
    assert got[0].text == "short article"
    assert got[3].text.startswith("real words") and got[3].n_chars == len(got[3].text)
    assert got[10].text == got[11].text == "" and got[10].url is None
    assert H.extract_pages(df.limit(0)).collect() == []


def test_query_gives_every_article(spark):
    import html
    import re
    rows = {r.page_id: r for r in spark.read.parquet(f"{SF001}/pages.parquet").collect()}
    got = QUERIES["op9_html_extraction"](spark, SF001).collect()
    assert len(got) == len(rows)
    for r in got:
        inside = re.search(r"<article>(.*?)</article>", rows[r.page_id].html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", " ", b))).strip() for b in re.split(r"</?(?:p|h1|div)\b[^>]*>", inside)]
        assert r.text == "\n\n".join(b for b in blocks if b)
        assert r.url == rows[r.page_id].url


def test_headings_leads_and_second_sections_stay(spark):
    long = "<p>" + "real words of the article, and more of them. " * 30 + "</p>"
    apart = "<article><h1>Title</h1><p>Lead</p><div class=body>{}</div></article>"
    unequal = "<div class=first>{}</div><div class=second><p>A short second section.</p></div>"
    for main in (apart, unequal):
        page_ = page(long, main)
        got = H.main_text(page_, [])
        assert got.startswith("Title\n\nLead\n\nreal" if main is apart else "real")
        assert main is apart or got.endswith("more of them.\n\nA short second section.")
    # most pages of the host have the body only
    rows = [(i, "http://a.example.org/", page(long, apart if i == 0 else "<article><div class=body>{}</div></article>")) for i in range(6)]
    rows += [(i, "http://b.example.org/", page(long, "<div class=x><h1>Title</h1><div class=body>{}</div></div>" if i == 6
                                               else "<div class=x><div class=body>{}</div></div>")) for i in range(6, 12)]
    got = {r.page_id: r.text for r in H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0].startswith("Title\n\nLead\n\nreal") and got[6].startswith("Title\n\nreal") and got[7].startswith("real")


def test_linked_lists_beside_the_body_are_left_out():
    links = "<div class=x><p><a href=/1>Another page</a></p></div>"
    assert H.main_text(page("<p>real words of the article</p>") + links, []) == "real words of the article"


def test_containers_that_hold_the_article_stay():
    article = "<p>" + "real words of the article, and more of them. " * 5 + "</p>"
    text = " ".join(["real words of the article, and more of them."] * 5)
    for name in ("content with-sidebar", "post has-comments", "article-share", "page-with-header", "sidebar-page"):
        assert H.main_text(page(f'<h1>A</h1><div class="{name}">{article}<div class=sidebar><p>side</p></div></div>'), []) == "A\n\n" + text
    assert H.main_text(f"<body><form action=/x><div class=a>{article}</div><form><p>Name</p></form></form></body>", []).startswith(text)
    # comments, however long, and what lies beside the article go as before
    comments = '<div class="{}">' + article * 20 + "</div>"
    assert H.main_text(page(article + comments.format("comments") + '<div class="related-posts"><p>More</p></div>'), []) == text
    assert H.main_text(page(f'<div class="post has-comments">{article}</div>' + comments.format("comment-list")), []) == text
    assert H.main_text("<p>for <math><mi>x</mi><mo>&lt;</mo><mn>3</mn></math> it holds</p>", []) == "for x<3 it holds"


def test_reader_comments_go_whatever_their_length():
    article = "<p>A short article.</p>"
    long = "<p>" + "what readers say about it, at length. " * 40 + "</p>"
    for name in ("reader-comments", "user-comments", "post-comments", "article-comments", "comments", "comment-list", "entry_comments"):
        for kind in ("class", "id"):
            for body in (f'{article}<div {kind}="{name}">{long}</div>', f'<article>{article}<section {kind}="x {name}">{long}</section></article>',
                         f'{article}<ol {kind}="{name}"><li>{long}<ol><li>{long}</li></ol></li><li>{long}</li></ol>'):
                assert H.main_text(page(body), []) == "A short article.", (name, body[:60])
                assert H.main_text(page(body), ["body>div.p#.post"]) == "A short article."
    # Names that speak about comments are not comments, and lists of the article stay.
    for name in ("has-comments", "no-comments", "comments-closed", "with_comments"):
        assert H.main_text(page(f'<div class="{name}">{long}</div>'), []).startswith("what readers")
    assert H.main_text(page(f"<ul class=points><li>one</li><li>two</li></ul>{long}"), []).startswith("one\n\ntwo\n\nwhat")


def test_odd_pages_of_a_megabyte_take_seconds():
    import time
    import tracemalloc
    n = 1_000_000
    pages_ = ["<a " * (n // 3), "<div class=abc>" * 8000 + "deep" + "</div>" * 8000, "<div class=abc>x" * 20_000, "</div>" * (n // 6),
              "<script " * (n // 8), "<!-- " * (n // 5), "<p title=\"" * (n // 10), "x > y " + "<b " * (n // 3), "<" * n, "<ol class=comments><li>x" * 20_000]
    for source in pages_:
        tracemalloc.start()
        t = time.time()
        H.main_text(source, ["body>div.abc"])
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert time.time() - t < 20 and most < 200e6, (source[:20], time.time() - t, most)


def test_text_behind_the_last_tag():
    assert H.main_text("<p>a</p> b <c d", []) == "a\n\nb <c d"
    assert H.main_text("<p>a</p> b <!-- c", []) == "a\n\nb"
    assert H.main_text("a < b <!doctype", []) == "a < b"
