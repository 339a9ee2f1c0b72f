from plumbline.llm.html_text import extract, main_text, smoothed, two_means_threshold

import numpy as np

PAGE = """<!DOCTYPE html><html><head><title>Title</title><style>p{}</style><script>var x = "<p>no</p>";</script></head><body>
<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div class="cookie-notice">We use cookies on this site, dear reader.</div>
<div class="has-sidebar"><%s><h1>A &amp; B</h1><p>First   <b>bold</b>er words,
of a paragraph that goes on.<p>Short.<br>After&nbsp;break <div class="ad">Buy now</div>
<form><label>Mail</label><input></form><ul><li>item one<li>item two</ul></%s></div>
<aside>Aside text</aside><div id="comments"><article><p>I, a reader, write a comment that is long enough to be an article.</p></article></div>
<footer>&copy; us</footer>"""


def test_article_only():
    want = "A & B First bolder words, of a paragraph that goes on. Short. After break item one item two"
    assert main_text(PAGE % ("article", "article")) == want
    assert main_text(PAGE % ("main", "main")) == want


def test_unmarked_pages_give_the_dense_region():
    words = "prose that runs for a good while without a tag in it. " * 4
    page = f"<body><div>menu <a>x</a></div><div id=main-text><h2>Head</h2><p>{words}</p><p>Brief.</p><p>{words}</p></div><div class=footer>legal</div></body>"
    assert main_text(page) == f"Head {words.strip()} Brief. {words.strip()}"


def test_no_paragraph_is_lost():
    long, short = "prose without an end " * 240, "a paragraph of about a hundred characters, which is part of the same text as all the others. "
    menu = "<ul>" + "<li><a href=/x>Link to somewhere</a></li>" * 6 + "</ul>"
    four = "".join(f"<p>{i} {short}</p>" for i in range(4))
    want = " ".join(["Head", long.strip(), *(f"{i} {short.strip()}" for i in range(4))])
    assert main_text(f"<body>{menu}<div><h2>Head</h2><p>{long}</p>{four}</div></body>") == want
    assert main_text(f"<body>{menu}<div><h1>Head</h1></div><div><div><p>{long}</p></div><div>{four}</div></div></body>") == want
    # a line of links amid the text stays
    linked = f"<div><p>{long}</p><p><a href=/s>The source</a></p>{four}</div>"
    assert main_text(f"<body>{menu}{linked}</body>") == want.removeprefix("Head ").replace("end 0", "end The source 0")


def test_all_articles_stay():
    part = "the part of a text that is split into several elements, each with words of its own. " * 2
    both = f"<article><p>1 {part}</p></article><article><p>2 {part}{part}</p></article>"
    links = "<article>" + "<p><a href=/x>Another story</a></p>" * 3 + "</article>"
    comment = f"<div class=comment-list><article><p>{part}</p></article></div>"
    want = " ".join(f"1 {part} 2 {part}{part}".split())
    assert main_text(f"<body>{both}{links}{comment}</body>") == want
    assert main_text(f"<body><main><h1>Head</h1>{both}</main>{comment}</body>") == f"Head {want}"


def test_marks_alone_drop_no_prose():
    part = "words of an article that go on for quite a while before the sentence ends at last. " * 2
    page = f"<body><%s><div class=article-header><p>Lead {part}</p></div><p>{part}</p><div class=share><a href=/f>Share</a> <a href=/t>Tweet</a></div><div id=promo>Buy</div><p>{part}</p></%s></body>"
    for tag in ("article", "div"):
        got = main_text(page % (tag, tag))
        assert got.endswith(" ".join(f"{part}{part}".split())) and "Buy" not in got and "Tweet" not in got
    assert main_text(page % ("article", "article")).startswith("Lead words")


def test_odd_pages(spark, nothing):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<nav>only</nav>"), (None, "u", "plain text &lt; more"), (5, "u", "<p>open <b>tags <article>never closed"), (5, "u", "<p>open <b>tags <article>never closed"),
            (6, "u", "<article>" + "<p>x &#233; y</p>" * 20_000 + "</article>"), (7, "u", "<article></article><![CDATA[x]]><!-- c"), (8, "u", "</div></p><>&#xZZ;&unknown; <article hidden>no</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'mine' AS text", "'mine' AS n_chars")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in extract(pages).collect())
    texts = {i: t for i, t, _ in got}
    assert all(n == len(t) for _, t, n in got) and len(got) == len(rows)
    assert texts[1] == texts[2] == texts[3] == "" and texts[0] == "plain text < more" and texts[5] == "never closed"
    assert texts[6] == " ".join(["x é y"] * 20_000)
    assert extract(pages.where("false")).isEmpty()


def test_smoothing_and_threshold():
    flat = smoothed(np.full(7, 3.0))
    assert np.allclose(flat, 3.0)
    assert 2 < two_means_threshold(np.array([1.0, 1.2, 0.9, 9.0, 10.0])) < 9
    assert two_means_threshold(np.array([4.0])) == 4.0
