"""Functions for SQL give what the operators give."""

from pyspark.sql import functions as F

from snapweave.functions.registry import register_functions
from snapweave.operators import extract, pages

HTML = [
    None, "", '<img src="a.png"><IMG SRC=\'/b.png\' alt=""><img data-src="no.png">', '<script src="https://x.org/a.js"></script><script>src="b"</script><iframe src="f/../g.html"></iframe>',
    '<link rel="STYLESHEET" href="s.css"><link rel="shortcut icon" href="//c.org/i.ico"><link rel="preload" as="font" href="f.woff2"><link rel="preload" as="fetch" href="no"><link rel="canonical" href="/no"><link rel="preload" as="style" href="s.css">',
    '<video poster="p.jpg" src="v.mp4"><source src="w.webm" srcset="one.png 1x, two,3.png 2x,">', "<div style=\"background:url(&quot;bg.png&quot;)\">url( 'x.woff' ) url(data:x) url(#f) url(%23f) url(javascript:1)</div>",
    '<img src="http://localhost/a"><img src="http://u@h.org/%7b%7bx"><img src="http://h.org/${a}"><img src="http://h.org/%zz"><img src="http://a b/"><img src="ftp://a/"><img src="x.css"><link rel="stylesheet" href="x.css">',
    '<img src="  sp.png "><img src="é/ü.png"><img src="http://É.org/a"><source src="x"><audio src="x">', '<img src="nbsp.png"><img src="q.png?a=1#b">',
]


def test_extract_resources_in_sql(spark):
    register_functions(spark)
    rows = spark.createDataFrame([(k, "https://site.example.com/d/e/page.html?q", h) for k, h in enumerate(HTML)], "page_id long, url string, html string")
    rows.createOrReplaceTempView("odd_pages")
    got = spark.sql("SELECT p.page_id, r.url, r.type FROM odd_pages p, LATERAL extract_resources(p.html, p.url) r").collect()
    want = extract.extract_resources(rows).select("page_id", "resource_url", "type").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 20


def test_highlight_in_sql(spark):
    register_functions(spark)
    terms, texts = [r"a\E.", "É", "<b", "x"], [r"A\e. and <b>", "été xX", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "body string")
    for term in terms:
        got = rows.select(F.expr("highlight_term(body, '" + term.replace("\\", "\\\\") + "')").alias("h"), pages.highlight_term(F.col("body"), term).alias("w")).collect()
        assert all(r.h == r.w for r in got), (term, got)
