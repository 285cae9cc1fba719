"""Pages whose text is inside an article element."""

from lociq.llm import html_diff


def test_article_text_stays_where_neighbours_have_it_around_theirs(spark):
    pages = []
    for k in range(6):
        here, there = ("<p>Read more of it</p>", "") if k % 2 else ("", "<aside><p>Read more of it</p></aside>")
        pages.append((k, f"http://a.example/n/{k}", f"<body><article><h1>Title {k}</h1><p>Own {k}</p>{here}</article>{there}</body>"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_diff.main_texts(df).collect()}
    assert got == {k: f"Title {k} Own {k}" + " Read more of it" * (k % 2) for k in range(6)}


def test_pages_with_an_article_are_aligned_too(spark):
    """what markup says nothing about is left to differencing beside an article too; with no other page to see, the article is the text."""
    page = lambda k: f"<nav>menu {k}</nav><h1>Title {k}</h1><div>Site line</div><article><p>Own {k}</p><p>The end</p></article><div>Later {k}</div><div>Site foot</div><footer>foot {k}</footer>"
    rows = [(k, f"http://a.example/n/{k}", page(k)) for k in range(9)]
    # Without an article as before; copies, repeated rows, a page alone on its host and one without url.
    rows += [(20 + k, f"http://b.example/{k}", page(k).replace("article>", "div>")) for k in range(3)]
    rows += [(30 + k, f"http://c.example/{k}", page(99)) for k in range(2)] + [(40, "http://d.example/", page(40))] * 2 + [(50, None, page(50))]
    want = {k: f"Title {k} Own {k} The end Later {k}" for k in range(9)} | {20 + k: f"Title {k} Own {k} Later {k}" for k in range(3)}
    want |= {30: "Own 99 The end", 31: "Own 99 The end", 40: "Own 40 The end", 50: "Own 50 The end"}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    try:
        for n in ("1", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            found = html_diff.main_texts(pages).collect()
            assert len(found) == len(rows) and {r.page_id: r.text for r in found} == want, n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_an_alignment_without_a_common_line_is_one():
    """A page that shares nothing with its neighbour is aligned; a page without neighbour is not."""
    own, other = ({"host": "h", "path": f"/{k}", "lines": [b"%d" % k]} for k in range(2))
    assert html_diff.site_lines(own, [other], []) == [] == html_diff.site_lines(own, [], [other])
    assert html_diff.site_lines(own, [], []) is None
