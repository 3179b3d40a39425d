import random
import time

from manloom.llm import html_main as H

PAGE = """<!DOCTYPE html><html lang=en><head><title>T</title><style>p{}</style><script>var t="</p><article>x";</script></head>
<body class="has-sidebar"><header class=top>Head</header><nav><ul><li><a href=/>Home</a></li></ul></nav><!-- ad > 1 -->
<div class="cookie-notice">We use cookies</div><div class="ad">Buy</div>
<article class="post-12"><header><h1>The&nbsp;Title &amp; more</h1></header><p><b>First &lt;line<br>second <i>li</i>ne<p>Third&#33; &copy
<aside>Side note</aside><form><input value="x>y">Your mail</form><ul><li>One<li>Two</ul><table><tr><td>a<td>b</table>
<div class="share">Share it</div><section class="comments"><article class=comment><p>@@</p></article></section><footer>By me</footer></article>
<div id="sidebar"><p>Other things</p></div><footer>&copy; site</footer></body></html>"""
TEXT = "The Title & more First <line second line Third! © One Two a b"


def test_page_alone():
    page = PAGE.replace("@@", "Nice read! " * 50)
    assert H.surveyed(page)[0] == "html>body.has-sidebar>article.post"
    assert H.main_text(page, []) == TEXT
    assert H.main_text(page, ["html>body>main", "html>body.has-sidebar>article.post"]) == TEXT


def test_broken_pages():
    assert H.main_text("", []) == "" and H.main_text("<", []) == "<" and H.main_text("<p", []) == "" and H.main_text("<!-- x", []) == ""
    assert H.main_text("plain &amp; text", []) == "plain & text"
    assert H.main_text("<div><p>a<div>b</div></p>c</div></div><p>d", []) == "a b c"
    assert H.main_text('<div class="x>y" title=\'"\'>t < u<script>no', []) == "t < u"


def test_long_and_deep_pages_take_linear_time():
    start = time.time()
    assert len(H.main_text("<div>" * 3000 + "<p>word</p>" * 100_000, [])) > 400_000
    H.main_text("<a \"" * 50_000, [])
    H.main_text("<script>" * 50_000 + "<!--" * 50_000, [])
    H.main_text("<b>" * 200_000 + "</i>" * 200_000 + "<ul>" * 100_000, [])
    assert H.main_text("<p>" + "<ul><b>" * 50_000 + "x" + "</ul>" * 50_000, []) == "x"
    H.main_text("<div><p>" * 100_000 + "</p></div>" * 100_000, [])
    assert time.time() - start < 30


def test_host_consensus(spark):
    body = lambda main, side: f'<html><body><div class="main{len(main)}"><p>{main}</p></div><div class="rail"><p>{side}</p></div></body></html>'
    rows = [(i, "http://a.example/x?y" if i % 2 else "https://u@A.example.:80", body("main text here", "side")) for i in range(9)]
    rows += [(9, "http://a.example", body("short", "a rail that is much longer than the main text of its page"))]
    rows += [(10, "http://b.example", body("short", "a rail that is much longer")), (11, None, None), (None, "x", ""), (0, rows[0][1], rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", __import__("pyspark").sql.functions.lit(1))
    got = H.extract(pages).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == len(rows)
    assert texts[9] == "short" and texts[1] == "main text here"  # the host outvotes the page
    assert texts[10] == "a rail that is much longer" and texts[11] == "" and texts[None] == ""
    assert all(r.n_chars == len(r.text) for r in got)
    assert H.extract(pages.limit(0)).count() == 0


def test_names_alone_drop_no_article_text():
    long = "word " * 60
    page = f'<body><article><p>{long}</p><section class="search-history"><p>the history of searching</p></section><div class="form-of-life"><p>a form of life</p></div><p>sum <math><mi>x</mi><mo>=</mo><mn>2</mn></math> end</p></article></body>'
    assert H.main_text(page, []) == f"{long}the history of searching a form of life sum x=2 end"


def test_sides_at_any_depth():
    page = "<div>" * 2000 + "<p>words of the article itself</p><nav><ul><li>menu</li></ul></nav><div class=ad><p>buy</p></div><p>more</p>" + "</div>" * 2000
    assert H.main_text(page, []) == "words of the article itself more"


def test_one_article_of_several():
    page = "<body><article><p>the article with all of its text</p></article><article><p>a teaser</p></article></body>"
    assert H.main_text(page, ["body>article"]) == "the article with all of its text"
    both = "<body><div class=part><p>one part of it</p></div><div class=part><p>another part</p></div></body>"
    assert H.main_text(both, ["body>div.part"]) == "one part of it another part"


def test_hosts_judge_doubtful_blocks(spark):
    page = lambda i, block: f'<body><article><p>{"text %d " % i * 20}</p>{block}</article></body>'
    links = '<div class="related-x"><a href=1>See this</a> <a href=2>and that</a></div>'
    rows = [(i, "http://a.example", page(i, '<div class="promo-strip"><p>Buy two, get three.</p></div>')) for i in range(6)]
    rows += [(10 + i, "http://b.example", page(10 + i, f'<div class="promo-strip"><p>Own words {i}.</p></div>')) for i in range(6)]
    rows += [(20, "http://c.example", page(20, links))]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, _ in rows:
        own = f" Own words {i - 10}." if 10 <= i < 20 else ""
        assert got[i] == ("text %d " % i * 20).strip() + own


def test_pages_made_around_known_articles(spark):
    """Articles put into layouts of many hosts; the text must come back as it went in."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    said = lambda n: " ".join(word() for _ in range(n))
    sides = [
        lambda: f"<nav><ul><li><a href=/>{said(1)}</a></li></ul></nav>", lambda: f"<header><h2>{said(3)}</h2></header>", lambda: f'<div class="sidebar left"><p>{said(30)}</p></div>', lambda: f"<footer><p>{said(9)}</p></footer>",
        lambda: f'<div id="cookie-notice"><p>{said(12)}</p></div>', lambda: f'<div class="ad-box"><p>{said(6)}</p></div>', lambda: f"<form><label>{said(2)}</label><input value='{said(1)}'></form>", lambda: f"<script>var x='<p>{said(5)}';</script><style>p{{}}</style>",
        lambda: f'<section class="comments"><div class="comment-body"><p>{said(40)}</p></div></section>', lambda: f"<aside><p>{said(20)}</p></aside>", lambda: "<!-- <p>no</p> -->",
    ]
    rows, truth = [], {}
    for host in range(12):
        open_, close = rng.choice([("<article>", "</article>"), ('<main><div class="story">', "</div></main>"), ('<div class="page-wrapper"><div class="entry">', "</div></div>"), ('<article class="post">', "</article>")])
        around = rng.sample(sides, 6)
        for k in range(8):
            blocks = [said(rng.randint(8, 40)) for _ in range(rng.randint(2, 6))]
            inside = [f"<h1>{blocks[0]}</h1>", *(rng.choice(["<p>{}</p>", "<p>{}", "<p><b>{}</b></p>", "<ul><li>{}</ul>", "<blockquote><p>{}</p></blockquote>"]).format(b) for b in blocks[1:])]
            inside.insert(rng.randint(1, len(inside)), rng.choice(sides[4:])())
            page = "<!DOCTYPE html><html><head><title>t</title></head><body>" + "".join(f() for f in around[:3]) + open_ + "".join(inside) + close + "".join(f() for f in around[3:]) + rng.choice(["</body></html>", ""])
            i = host * 100 + k
            rows.append((i, f"https://h{host}.example/{k}", page))
            truth[i] = " ".join(blocks)
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == truth


def test_articles_in_parts(spark):
    """Known articles that are spread over containers, with ids made from headings and second parts."""
    rng = random.Random(11)
    prose = lambda n: " ".join(rng.choice("lorem ipsum dolor sit amet elit sed do tempor".split()) for _ in range(n))
    make = {
        "siblings": lambda a, b: f'<div class=post><div class=intro><p>{a}</p></div><div class=details><p>{b}</p></div></div>',
        "direct": lambda a, b: f'<div class=story>{a[:80].strip()}<div class=more><p>{b}</p></div></div>',
        "ids": lambda a, b: f'<article><h2 id=search>Search</h2><section id=forms><p>{a}</p></section><section id=social><p>{b}</p></section></article>',
        "two": lambda a, b: f'<main><article><p>{a}</p></article><article><p>{b}</p></article><article class=card><p>Read on</p></article></main>',
        "comments": lambda a, b: f'<article><p>{a}</p><p>{b}</p></article><div class=discussion><p>{prose(90)}</p></div>',
        "rail": lambda a, b: f'<div class=wrap><div class=text><p>{a}</p><p>{b}</p></div><div class=col2><p>About this site and those who write it, and where to find them all</p></div></div>',
    }
    want = {"direct": lambda a, b: f"{a[:80].strip()} {b}", "ids": lambda a, b: f"Search {a} {b}"}
    rows, texts = [], {}
    for k, (name, page) in enumerate(make.items()):
        for i in range(12):
            a, b = prose(60), prose(70)
            rows.append((100 * k + i, f"http://{name}.example/{i}", f"<html><body><nav><a href=/>Home</a></nav>{page(a, b)}<footer>Foot</footer></body></html>"))
            texts[100 * k + i] = want.get(name, lambda a, b: f"{a} {b}")(a, b)
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: v for k, v in got.items() if v != texts[k]} == {}
