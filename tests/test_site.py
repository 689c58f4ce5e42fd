import json

from pyspark.sql import functions as F

from webloom.operators import answers as A
from webloom.operators import audit as Q1
from webloom.operators import contacts as Q2
from webloom.operators import hooks
from webloom.operators import validate as V
from webloom.operators.extract import extract, lift_pages
from webloom.operators.markup import content_blocks, extract_page, json_ld, microdata, parse
from webloom.plans import pipeline

LD = {"@context": "x", "@graph": [{"@type": "LocalBusiness", "name": "Harbor Bikes", "telephone": "(415) 555-0123", "address": {"streetAddress": "77 NW Pine St", "addressLocality": "Lisbon"}}]}
WORDS = " ".join(f"word{i}" for i in range(160))
CLEAN = f"""<html><head><title>Harbor Bikes repairs wheels in Lisbon</title><meta name="description" content="{'d' * 100}"><link rel="canonical" href="/">
<meta name="robots" content="index, follow"><meta property="og:title" content="a"><meta property="og:description" content="b"><meta property="og:image" content="c">
<script type="application/ld+json">{json.dumps(LD)}</script></head><body><nav><a href="/about">About the company we are</a></nav><main><h1>Harbor</h1><h2>Wheels</h2>
<p>We repair bicycle wheels daily in small batches.</p><p>{WORDS}</p><img src="a.png" alt=""><a href="/gone">gone</a></main><footer>© 2026 Harbor Bikes</footer></body></html>"""
MESSY = """<head><title></title><link rel=canonical href="http://[bad"><link rel=canonical href="/b"><meta name=ROBOTS content="NOINDEX,nofollow"><meta name=description content="">
<body><h1>One</h1><p>Unclosed para one that is long enough<p>wor<b>ld</b> two<h1>Two</h1><h3>Three</h3><ul><li>first item of the list is long<li>second item of the list is long</ul><img src=x.png><img src=y.png alt="">
<script type="application/ld+json">{broken</script>"""
ABOUT = """<title>Harbor Bikes repairs wheels in Lisbon</title><body><p>Call (415) 555-0188 today, or visit 77 Northwest Pine Street Suite 300.</p><a href="tel:+14155550123">415-555-0123</a><footer>© 2026 Harbor Bikes LLC</footer>"""


def fetches(spark, extra=()):
    pages = spark.createDataFrame([(0, "https://harbor.example/", CLEAN), (1, "https://harbor.example/messy", MESSY), (2, "https://harbor.example/about", ABOUT), *extra], "page_id long, url string, html string")
    return lift_pages(pages)


def test_parse_recovers():
    x = extract_page(MESSY, "https://m.example/p")
    assert x["title"] == "" and x["canonical"] is None and x["canonical_count"] == 2
    assert x["html_robots_meta"] == ["noindex", "nofollow"]
    assert [i["alt"] for i in x["images"]] == [None, ""] and x["structured_data"] == []
    assert "wor ld two" in x["text"]
    assert "first item of the list is long" in [b["text"] for b in x["blocks"]]
    for b in x["blocks"]:
        assert x["text"][b["start"] : b["end"]] == b["text"]
    assert extract_page(None, None)["text"] == "" and extract_page("<<<", "x")["title"] is None


def test_open_references_stay():
    """A name after & without its semicolon, or an unknown one, is text, as where a title was cut inside of a reference."""
    x = extract_page('<title>a &amp;&amp</title><p>R&D &copy; &copyx; &am &#65; &lt;b&gt; &amp;lt;</p><a href="/x?a=1&copy=2&amp;b=3&lt">q&amp</a><script type="application/ld+json">{"@type": "Store", "name": "A &amp B"}</script>', "https://m.example/p")
    assert x["title"] == "a &&amp" and x["text"] == "a &&amp R&D © &copyx; &am A <b> &lt; q&amp"
    assert x["links"] == [{"href": "https://m.example/x?a=1&b=3&copy=2&lt=", "anchor_text": "q&amp"}]
    assert json.loads(x["structured_data"][0])["name"] == "A &amp B"


def test_workers_get_few_pages_at_a_time(spark, monkeypatch):
    """What is found on a page leaves the worker before the next ones of a large batch are parsed."""
    from webloom.operators import extract as E

    monkeypatch.setattr(E, "AT_ONCE", 2)
    whole = lift_pages(spark.range(7).selectExpr("id AS page_id", "'https://m.example/' || id AS url", "'<title>t' || id || '</title>' AS html").coalesce(1))
    assert sorted((r.pos, r.title) for r in extract(whole).collect()) == [(i, f"t{i}") for i in range(7)]


def test_built_pages_are_dealt_out(spark, tmp_path):
    """Rows of one small file become pages in many tasks."""
    from webloom.plans import built

    spark.range(200).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    tasks = built.fetches(spark, str(tmp_path)).select(F.spark_partition_id().alias("t"), "pos").collect()
    assert len(tasks) == 200 and len({r.t for r in tasks}) > 4


def test_content_and_structures():
    root = parse(CLEAN)
    assert "About the company we are" not in content_blocks(root) and content_blocks(root)[0].startswith("We repair")
    assert [d["@type"] for d in json_ld(root)] == ["LocalBusiness"]
    item = microdata(parse('<div itemscope itemtype="http://schema.org/Store"><span itemprop=priceRange>££</span><div itemprop=address itemscope itemtype="http://schema.org/PostalAddress"><meta itemprop=postalCode content=1></div></div>'))
    assert item == [{"@type": "Store", "priceRange": "££", "address": {"@type": "PostalAddress", "postalCode": "1"}}]


def checks(df, url):
    return sorted(r.check_id.removeprefix("SEO-") for r in df.collect() if r.page == url)


def test_page_checks(spark):
    f = Q1.page_findings(extract(fetches(spark))).cache()
    assert checks(f, "https://harbor.example/") == []
    assert checks(f, "https://harbor.example/messy") == ["CANON-002", "CONTENT-001", "HEAD-002", "HEAD-004", "IMG-001", "INDEX-001", "INDEX-002", "META-002", "SOCIAL-001", "TITLE-002"]
    by = {r.check_id: r.evidence for r in f.collect() if r.page.endswith("messy")}
    assert by["SEO-HEAD-004"] == "Heading levels jump from <h1> to <h3> with no <h2> in between."
    assert by["SEO-IMG-001"] == "1 of 2 <img> elements have no alt attribute: https://harbor.example/x.png"
    assert by["SEO-CANON-002"].endswith("the first points to None.")


def test_cross_page_and_validation(spark):
    gone = spark.createDataFrame([("harbor.example", 9, "https://harbor.example/gone", 404)], "site string, pos long, url string, status_code int")
    base = fetches(spark)
    more = base.unionByName(gone.select("site", "pos", "url", F.col("url").alias("final_url"), "status_code", F.lit(None).cast("timestamp").alias("fetched_at"), F.lit("").alias("html"), F.lit(1).alias("depth"), F.lit("text/html").alias("content_type"), F.array().cast("array<string>").alias("x_robots_tag"), F.array(F.lit("https://a/"), F.lit("https://b/")).alias("redirect_chain"), F.lit(None).cast("string").alias("error")))
    pages = extract(more).cache()
    found = Q1.audit(pages, more).cache()
    by = {(r.check_id, r.page): r.evidence for r in found.collect()}
    assert by["SEO-DUP-001", "https://harbor.example/about"] == 'This page\'s <title> "Harbor Bikes repairs wheels in Lisbon" is also used on 1 other page(s): https://harbor.example/'
    assert by["SEO-LINK-001", "https://harbor.example/"] == "1 internal link(s) on this page returned an error status during the crawl: https://harbor.example/gone (404)"
    assert by["SEO-REDIR-001", "https://harbor.example/gone"] == "2 redirect hops before the final URL: https://a/ -> https://b/ -> https://harbor.example/gone"
    kept = {r.check_id for r in V.valid_findings(found, pages).collect()}
    assert "SEO-LINK-001" not in kept and "SEO-REDIR-001" not in kept and "SEO-DUP-001" in kept
    assert {r.check_id for r in V.valid_findings(found, pages, more).collect()} >= {"SEO-LINK-001", "SEO-REDIR-001"}
    fake = found.limit(1).withColumn("evidence", F.lit("made up"))
    assert V.valid_findings(fake, pages).count() == 0
    order = [r.severity for r in Q1.ordered(found).collect()]
    assert order == sorted(order, key=["critical", "warning", "info"].index)


def test_nap(spark):
    pages = extract(fetches(spark)).cache()
    report = Q2.describe(Q2.nap_report(pages)).cache()
    r = {x.field: x for x in report.collect()}
    assert r["name"].verdict == "inconsistent" and "differ only by legal suffix" in r["name"].explanation
    assert r["phone"].normalized_values == ["4155550123"] and r["phone"].verdict == "consistent"  # the visible one gives way to the link
    assert r["address"].normalized_values == ["77 northwest pine street lisbon"] and r["address"].verdict == "consistent"
    plain = report.drop("explanation")
    assert V.valid_report(plain, pages).count() == 3
    assert V.valid_report(plain.withColumn("verdict", F.lit("consistent")), pages).count() == 2
    assert Q2.compare(Q2.candidates(pages.where("false")), pages.select("site")).where("verdict = 'insufficient_data' and confidence = 0.0").count() == 3


def test_answers(spark):
    pages = extract(fetches(spark)).cache()
    q = spark.createDataFrame([("harbor.example", 1, "repairing bicycle wheels daily?"), ("harbor.example", 2, "Do you sell repair bicycle wheels daily"), ("harbor.example", 3, "refund policy"), ("harbor.example", 4, "the of")], "site string, qid int, query string")
    a = {r.qid: r for r in A.answer(pages, q).collect()}
    assert a[1].excerpt == "We repair bicycle wheels daily in small batches." and a[1].match_type == "exact_substring"
    assert a[2].excerpt is not None and a[3].excerpt is None and a[4].url is None
    good = spark.createDataFrame([("harbor.example", "https://harbor.example/", '"We repair  bicycle wheels daily"'), ("harbor.example", "https://harbor.example/", "never said"), ("harbor.example", None, None)], "site string, url string, excerpt string").withColumn("match_type", F.lit("exact_substring"))
    assert [r.match_type for r in V.valid_answers(good, pages).orderBy(F.desc("excerpt")).collect()].count("exact_substring") == 1


def ranked(texts, questions, k):
    """The same ranking, written plainly: all chunks of a site for each question."""
    import math
    from collections import Counter

    out = {}
    for site, qid, query in questions:
        docs = [(i, t.split()) for s, i, t in texts if s == site]
        df = Counter(t for _, d in docs for t in set(d))
        raw = {t: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
        idf = {t: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, x in raw.items()}
        mean = sum(len(d) for _, d in docs) / max(len(docs), 1)
        score = lambda d: sum(n * idf[t] * (f := d.count(t)) * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(d) / mean)) for t, n in Counter(query.split()).items() if t in idf)  # noqa: B023, E731
        best = sorted((-round(score(d), 9), i) for i, d in docs)[:k]
        out |= {(site, qid, r + 1): (i, -x) for r, (x, i) in enumerate(best)}
    return out


def test_ranking_of_many_questions(spark, monkeypatch):
    """Common and rare tokens apart, tokens in rounds and few scores at once give the ranking of all chunks, ties and chunks that share nothing included."""
    import random

    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rng.choice(words[: rng.choice((4, 30))]) for _ in range(n))
    texts = [(rng.choice("aab"), (i, i % 3), text(rng.randrange(0, 9))) for i in range(90)] + [("c", (1, 1), "w1")]
    asked = [(s, i, text(rng.randrange(1, 6)) + " z1" * (i % 2)) for i in range(40) for s in "abd"]
    c = spark.createDataFrame(texts, "site string, chunk_id struct<pos:long,i:int>, text string").repartition(3)
    q = spark.createDataFrame(asked, "site string, qid long, query string")
    want = ranked(texts, asked, 4)
    score = {(s, i): x for (s, i, _), x in want.items()}
    assert len(score) == 80
    for few, rare, rows in ((1000, 0, 10**6), (0, 3, 40), (0, 0, 10**6), (0, 1000, 10**6)):
        for name, value in (("FEW", few), ("RARE", rare), ("ASKED_ROWS", rows), ("CELLS", 50)):
            monkeypatch.setattr(A, name, value)
        got = {(r.site, r.qid, r.rank): (tuple(r.chunk_id), r.score) for r in A.top_k(c, q, 4).collect()}
        assert got.keys() == want.keys()
        assert all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 1e-8 for x in want)
    pairs = {(s, i, q) for s, i, t in texts for s2, q, x in asked if s == s2 and set(t.split()) & set(x.split())}
    assert {(r.site, tuple(r.chunk_id), r.qid) for r in A.bm25(c, q).collect()} == pairs


def test_hooks(spark):
    pages = extract(fetches(spark)).cache()
    f = Q1.page_findings(pages)
    assert {r.suggested_fix for r in hooks.suggest_fixes(f, lambda p: " short ").collect()} == {"short"}

    def fails(p):
        raise RuntimeError

    assert hooks.suggest_fixes(f, fails).select("suggested_fix").distinct().count() == f.select("suggested_fix").distinct().count()
    v = hooks.recover_values(pages, ["phone"], lambda p: '<think>x</think>```json\n{"phone": "(415) 555-0188", "name": "no"}```').collect()
    assert [(r.page, r.normalized_value) for r in v] == [("https://harbor.example/about", "4155550188")]
    assert hooks.filter_candidates(Q2.candidates(pages), lambda p: "No." if "phone" in p else "yes").where("field = 'phone'").count() == 0


def test_pipeline_files(spark, tmp_path):
    q = spark.createDataFrame([("harbor.example", 1, "repair bicycle wheels daily")], "site string, qid int, query string")
    r = pipeline.run(fetches(spark), q)
    files = pipeline.write_site(r, str(tmp_path), "harbor.example")
    assert set(files) == {"audit", "nap_report", "answer"}
    audit = json.loads((tmp_path / "audit.json").read_text())
    assert audit and set(audit[0]) == {"metric", "page", "severity", "evidence", "suggested_fix"} and audit[0]["severity"] == "critical"
    assert json.loads((tmp_path / "answer.json").read_text())["url"] == "https://harbor.example/"
    assert [x["field"] for x in json.loads((tmp_path / "nap_report.json").read_text())] == ["name", "address", "phone"]


def test_streaming(spark, tmp_path):
    from webloom.streaming.audits import stream_findings

    fetches(spark).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    run = stream_findings(s).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    assert spark.table("found").count() == Q1.page_findings(extract(fetches(spark))).count()
