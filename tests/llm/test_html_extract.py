from gatecast.llm import html_extract as h

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><article>no</article>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad 1 <p>x</p> -->
<div class="page-{n}"><div class="sidebar left"><p>Side, with, many, commas, in, it, to, look, like, text, and, more.</p></div>
<div class="story s{n}"><h1>Title {n}</h1><p>One &amp; two &eacute;&#233;&#x41; a&lt;b<p>Three<br>four  <b>fi</b>ve
six</p><div class="share-buttons">Share!</div><p>Seven, eight, nine, ten and some more text to be long enough.</p>
<form><p>Mail <input name=a><button>Go</button></p></form><div id="comments"><p>First!!!</p></div></div></div>
<footer>&copy; me</footer></body></html>"""
WANT = "Title {n} One & two ééA a<b Three four five six Seven, eight, nine, ten and some more text to be long enough."


def test_template_pages_and_odd_ones(spark):
    rows = [(i, "http://Host.example/x", PAGE.format(n=i), "extra") for i in range(8)]
    rows += [(100, "http://host.example/y", "<article><p>Only an article here.</article>", None), (101, None, None, None), (102, "u", "", None),
             (103, "http://other.example", "no markup at all & more", None), (104, "http://other.example", "<p>open <b>bold <i>text", None),
             (105, "http://other.example", "</div></p>a < b <3 <!-- never closed <p>z", None), (105, "http://other.example", "<p>again", None),
             (106, "http://other.example", "<div>" * 3000 + "deep", None), (107, "http://big.example", "<article>" + "<p>word</p>" * 20000 + "</article>", None)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    out = h.extract_pages(docs).collect()
    assert len(out) == len(rows)
    got = {}
    for r in out:
        assert r.n_chars == len(r.text)
        got.setdefault(r.page_id, []).append(r.text)
    for i in range(8):
        assert got[i] == [WANT.format(n=i)]
    assert got[100] == ["Only an article here."]
    assert got[101] == got[102] == [""]
    assert got[103] == ["no markup at all & more"]
    assert got[104] == ["open bold text"]
    assert sorted(got[105]) == ["a < b <3", "again"]
    assert got[106] == ["deep"]
    assert got[107] == [" ".join(["word"] * 20000)]
    assert h.extract_pages(spark.createDataFrame([], docs.schema)).collect() == []


def test_hosts_vote(spark):
    """A page whose best container is another one still follows its host."""
    odd = PAGE.format(n=1).replace("Side, with,", "Side, with, " + "a lot, of, text, " * 60).replace('class="sidebar left"', 'class="left"')
    docs = spark.createDataFrame([(i, "http://a.b/", PAGE.format(n=i)) for i in range(5)] + [(9, "http://a.b/", odd)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in h.extract_pages(docs).collect()}
    assert h.best_path(*h.read_blocks(odd))[0] != h.best_path(*h.read_blocks(PAGE.format(n=1)))[0]
    assert got[9] == WANT.format(n=1)


BODY = "<h1>The title</h1><p>A first paragraph, long enough to be told from the rest of the page.</p><p>A second one.</p>"
TEXT = "The title A first paragraph, long enough to be told from the rest of the page. A second one."
MORE = '<nav><a href="/">Home</a></nav><div class="sidebar"><p>Other things.</p></div><div class="ad-top">Buy!</div>'


def whole(page):
    return h.extract(f"<html><body>{MORE}{page}<footer>me</footer></body></html>", [])


def test_wrappers_that_hold_the_article():
    for attrs in ('style="overflow:hidden"', 'aria-hidden="false"', 'class="content has-sidebar"', 'class="content-sidebar-wrap"', 'class="no-sidebar"',
                  'class="widget"', 'id="banner" class="x"', 'data-x="hidden menu"'):
        assert whole(f"<div {attrs}><article>{BODY}</article></div>") == TEXT, attrs
        assert whole(f"<div {attrs}>{BODY}</div>") == TEXT, attrs


def test_parts_of_an_article():
    for name in ("article-header", "entry-header", "related-work", "social-studies"):
        page = f'<article><div class="{name}"><h2>Its part.</h2></div>{BODY}</article>'
        assert whole(page) == "Its part. " + TEXT, name
    for attrs in ("hidden", 'aria-hidden="true"', 'class="share-buttons"', 'class="related-posts"', 'class="ad"', 'class="widget_2"', 'role="search"'):
        assert whole(f"<article>{BODY}<div {attrs}><p>Not this.</p></div></article>") == TEXT, attrs


def test_comments_longer_than_the_article():
    said = '<article class="comment-body"><p>I, for one, say a lot, and more, and more.</p></article>' * 30
    assert whole(f'<article>{BODY}<div id="comments">{said}</div></article>') == TEXT
    assert whole(f'<article>{BODY}</article><div id="comments">{said}</div>') == TEXT


def test_advert_longer_than_the_page():
    advert = '<div class="{}"><p>' + "Buy this, or that, or both of them, now. " * 9 + "</p></div>"
    for name in ("ad", "ad-top", "sponsored"):
        assert whole(advert.format(name) + f"<article>{BODY}</article>") == TEXT
        assert whole(advert.format(name) + f"<div>{BODY}</div>") == TEXT
    assert whole(advert.format("sidebar") + f"<article>{BODY}</article>") == TEXT


def test_names_of_reader_comments():
    said = "<p>I, for one, say a lot, and more, and more.</p>"
    for name in ("user-comment", "reader-feedback", "visitor_replies", "discussion-thread", "post-comment", "user-reviews"):
        for n in (1, 40):
            assert whole(f'<article>{BODY}</article><div class="{name}">{said * n}</div>') == TEXT, name
            assert whole(f'<article>{BODY}<div class="{name}">{said * n}</div></article>') == TEXT, name
    for name in ("discussion", "feedback-loops", "commentary", "reader"):
        assert whole(f'<article><div class="{name}"><h2>Its part.</h2></div>{BODY}</article>') == "Its part. " + TEXT, name
