import gzip

from pyspark.sql import functions as F

from webloom.sources import crawl as K
from webloom.sources.http import fetch


def web(spark):
    page = lambda *links: "".join(f"<a href='{x}'>x</a>" for x in links)
    rows = [("/", 200, page("/about", "/contact#x", "/private/secret", "https://other.example/"), "text/html"), ("/about", 200, page("/team", "/"), "text/html"), ("/contact", 404, "", "text/html"), ("/team", 200, page("/deep", "/doc.pdf"), "text/html"), ("/deep", 200, "", "text/html"), ("/doc.pdf", 200, page("/never"), "application/pdf")]
    df = spark.createDataFrame([("https://s.example" + p, s, h, c) for p, s, h, c in rows], "url string, status_code int, html string, content_type string")
    none = F.array().cast("array<string>")
    return df.select("url", F.col("url").alias("final_url"), "status_code", "html", "content_type", none.alias("x_robots_tag"), none.alias("redirect_chain"), F.lit(None).cast("string").alias("error"))


def test_crawl(spark):
    seeds = spark.createDataFrame([("s.example", "HTTPS://s.example")], "site string, url string")
    robots = spark.createDataFrame([("s.example", 200, "User-agent: *\nDisallow: /private/")], "site string, status_code int, body string")
    got, skipped = K.crawl(seeds, web(spark), robots=robots, max_depth=2)
    paths = [(r.final_url.removeprefix("https://s.example"), r.depth, r.pos) for r in got.orderBy("pos").collect()]
    assert paths == [("/", 0, 0), ("/about", 1, 1), ("/contact", 1, 2), ("/team", 2, 3)]
    assert {(r.url, r.reason) for r in skipped.collect()} == {("https://s.example/private/secret", "robots_disallow"), ("https://other.example/", "off_domain")}
    deep, _ = K.crawl(seeds, web(spark), robots=robots, max_depth=9)
    assert deep.where("final_url like '%pdf'").first().html == "" and deep.where("final_url like '%never'").count() == 0
    few, _ = K.crawl(seeds, web(spark), max_pages=2)
    assert few.count() == 2
    down = robots.withColumn("status_code", F.lit(503))
    assert K.crawl(seeds, web(spark), robots=down)[0].count() == 0
    report = K.crawl_report(got, skipped).first()
    assert (report.pages_fetched, report.pages_ok, report.skipped) == (4, 3, {"off_domain": 1, "robots_disallow": 1})


def test_sitemaps(spark):
    index = b"<sitemapindex xmlns='n'><sitemap><loc> https://s.example/a.xml </loc></sitemap><sitemap><loc>https://s.example/bad.xml</loc></sitemap></sitemapindex>"
    urls = gzip.compress(b"<urlset><url><loc>https://s.example/x</loc></url><url><loc>https://www.s.example/y#f</loc></url><url><loc>https://o.example/</loc></url></urlset>")
    docs = spark.createDataFrame([("https://s.example/sitemap.xml", index), ("https://s.example/a.xml", urls), ("https://s.example/bad.xml", b"<x")], "url string, body binary")
    seeds = spark.createDataFrame([("s.example", "https://s.example/sitemap.xml")], "site string, url string")
    assert sorted(r.url for r in K.sitemap_urls(seeds, docs).collect()) == ["https://s.example/x", "https://www.s.example/y"]


def test_fetch_retries():
    tries = []

    def get(url, agent, timeout):
        tries.append(url)
        return (url, 503, {}, b"", []) if len(tries) < 3 else (url, 200, {"Content-Type": "text/html; charset=x", "X-Robots-Tag": "noindex"}, b"<p>", ["a"])

    row = fetch("http://x/", get=get, pause=lambda s: None)
    assert row[2:] == (200, "<p>", "text/html", ["noindex"], ["a"], None) and len(tries) == 3

    def broken(*a):
        raise OSError("no")

    assert fetch("http://x/", get=broken, pause=lambda s: None)[2] == 0
    assert K.crawl_delay("User-agent: *\nCrawl-delay: 3", "b") == 3.0


def network(pages):
    """How to get the addresses of a small network; a closure, so that workers need not import this file."""

    def get(url, agent, timeout):
        if url not in pages:
            return url, 404, {"Content-Type": "text/html"}, b"", []
        kind, body = pages[url]
        return url, 200, {"Content-Type": kind}, body, []

    return get


def test_live_crawl(spark, tmp_path):
    from webloom.plans import pipeline

    html = "text/html; charset=utf-8"
    net = network(
        {
            "https://s.example/robots.txt": ("text/plain", b"User-agent: *\nDisallow: /no/\nCrawl-delay: 1\nSitemap: https://s.example/maps/a.xml"),
            "https://s.example/maps/a.xml": ("text/xml", b"<sitemapindex><sitemap><loc>https://s.example/maps/b.xml</loc></sitemap></sitemapindex>"),
            "https://s.example/maps/b.xml": ("text/xml", b"<urlset><url><loc>https://s.example/hidden</loc></url></urlset>"),
            "https://s.example/sitemap.xml": ("text/xml", b"<urlset><url><loc>https://s.example/usual</loc></url></urlset>"),
            "https://s.example/": (html, b"<title>Home</title><a href='/a'>a</a><a href='/no/b'>b</a><a href='/gone'>c</a><p>We mend bicycle wheels every day of the week.</p>"),
            "https://s.example/a": (html, b"<title>A</title>"),
            "https://s.example/hidden": (html, b"<title>Hidden</title>"),
            "https://s.example/usual": (html, b"<title>Usual</title>"),
        }
    )
    seeds = spark.createDataFrame([("s.example", "https://s.example/")], "site string, url string")
    pages, skipped, notes = K.live_crawl(seeds, get=net, pause=lambda s: None)
    status = {r.url.removeprefix("https://s.example"): (r.status_code, r.depth) for r in pages.collect()}
    assert status == {"/": (200, 0), "/hidden": (200, 1), "/usual": (200, 1), "/a": (200, 1), "/gone": (404, 1)}
    assert [(r.url, r.reason) for r in skipped.collect()] == [("https://s.example/no/b", "robots_disallow")]
    assert [tuple(r) for r in notes.collect()] == [("s.example", "ok", 2)]
    few, _, notes = K.live_crawl(seeds, respect_robots=False, use_sitemap=False, get=net, pause=lambda s: None)
    assert few.count() == 4 and notes.first().sitemap_urls_found == 0
    result, notes = pipeline.run_site(spark, "https://s.example/", "Do you mend bicycle wheels?", get=net, pause=lambda s: None)
    assert result.answers.first().excerpt == "We mend bicycle wheels every day of the week." and result.findings.count() > 0
    n = notes.first()
    assert (n.pages_fetched, n.pages_ok, n.robots, n.skipped) == (5, 4, "ok", {"robots_disallow": 1})


def test_robots_delay(spark):
    bodies = ["User-agent: *\nCrawl-delay: 4", "User-agent: *\nRequest-rate: 1/8", "", None]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    assert [r.d for r in df.orderBy("i").select(K.host_delay("webloom")("body").alias("d")).collect()] == [4.0, 8.0, 0.0, 0.0]
