"""A crawl over tables: a breadth-first loop of waves, each a plan of joins, with robots rules and sitemaps."""

from __future__ import annotations

import gzip
import urllib.robotparser
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from webloom.functions import urls as U
from webloom.operators.extract import is_html, is_ok
from webloom.sources.http import fetched
from webloom.storage import materialize

HREF = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']+)["']"""
SITEMAP_PATHS = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemap/sitemap.xml"]
SITEMAP_DEPTH, SITEMAP_CAP = 3, 5000


def frontier_links(html: Column) -> Column:
    """href values of a page as written, fragments left out."""
    return F.filter(F.transform(F.regexp_extract_all(html, F.lit(HREF), 1), lambda h: F.btrim(h)), lambda h: (h != "") & ~h.startswith("#"))


def looks_script_rendered(html: Column) -> Column:
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<[^>]+>", " ")
    return (F.char_length(F.btrim(F.regexp_replace(bare, r"\s+", " "))) < 200) & html.rlike(r"(?i)<script\b")


def robots_status(status: Column, body: Column) -> Column:
    return F.when(status.isNull(), "fetch_failed").when(status >= 500, "server_error").when(status >= 400, "missing").otherwise("ok")


def may_fetch(agent: str):
    """Column function (body, url): whether robots rules let the agent fetch."""

    def check(body: pd.Series, url: pd.Series) -> pd.Series:
        parsed, out = {}, []
        for b, u in zip(body, url, strict=True):
            if b is None:
                out.append(True)
                continue
            if b not in parsed:
                parsed[b] = p = urllib.robotparser.RobotFileParser()
                p.parse(b.splitlines())
            out.append(parsed[b].can_fetch(agent, u))
        return pd.Series(out)

    return F.pandas_udf(check, BooleanType())


def crawl_delay(body: str | None, agent: str, least: float = 0.2) -> float:
    p = urllib.robotparser.RobotFileParser()
    p.parse((body or "").splitlines())
    rate = p.request_rate(agent)
    told = p.crawl_delay(agent) or (rate.seconds / rate.requests if rate and rate.requests else 0)
    return max(least, float(told))


def host_delay(agent: str):
    """Column function (body): the seconds that robots rules ask for between fetches, 0 if none."""
    return F.pandas_udf(lambda body: pd.Series([crawl_delay(b, agent, 0.0) for b in body]), "double")


def sitemap_lines(body: Column) -> Column:
    """The addresses in the Sitemap lines of robots rules."""
    return F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"(?im)^\s*sitemap\s*:\s*(\S+)"), 1)


def sitemap_seeds(seeds: DataFrame, robots: DataFrame) -> DataFrame:
    """(site, url) where sitemaps may lie: those that robots rules name and the usual places. seeds(site, url), robots(site, status_code, body)."""
    named = robots.where("status_code < 400").select("site", F.explode(sitemap_lines(F.col("body"))).alias("url"))
    usual = seeds.select("site", F.explode(F.transform(F.array(*[F.lit(p) for p in SITEMAP_PATHS]), lambda p: F.concat(F.regexp_extract("url", r"(?i)^(https?://[^/?#]*)", 1), p))).alias("url"))
    return named.union(usual).distinct()


def allowed(candidates: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """candidates(site, url) with allowed; robots(site, status_code, body). A failing server denies all, a missing file allows all."""
    r = robots.select("site", robots_status(F.col("status_code"), F.col("body")).alias("robots"), "body")
    c = candidates.join(r, "site", "left")
    rules = F.when(F.col("robots") == "ok", F.col("body"))
    return c.withColumn("allowed", F.when(F.col("robots") == "server_error", False).otherwise(may_fetch(agent)(rules, F.col("url")))).drop("robots", "body")


def parse_sitemap(raw: bytes | None) -> tuple[str, list[str]]:
    """Kind (urlset, sitemapindex or '') and the places it lists; broken files list nothing."""
    try:
        if raw and raw[:2] == b"\x1f\x8b":
            raw = gzip.decompress(raw)
        root = ET.fromstring(raw or b"")
    except Exception:  # noqa: BLE001
        return "", []
    name = lambda e: e.tag.rsplit("}", 1)[-1].lower()
    out = []
    for child in root:
        loc = next((e.text for e in child if name(e) == "loc"), None)
        if loc and loc.strip():
            out.append(loc.strip())
    return name(root), out


@F.pandas_udf(StructType([StructField("kind", StringType()), StructField("locs", ArrayType(StringType()))]))
def sitemap_entries(raw: pd.Series) -> pd.DataFrame:
    rows = [parse_sitemap(bytes(r) if r is not None else None) for r in raw]
    return pd.DataFrame({"kind": [r[0] for r in rows], "locs": [r[1] for r in rows]})


def sitemap_urls(seeds: DataFrame, documents, cap: int = SITEMAP_CAP) -> DataFrame:
    """seeds(site, url) of sitemaps: (site, url) that they list, through indexes SITEMAP_DEPTH deep. documents: a table (url, body binary), or a function that fetches such a table for urls(url)."""
    entries = lambda d: d.select("url", sitemap_entries("body").alias("s")).select("url", "s.kind", "s.locs")
    level, found, seen = seeds.select("site", "url").distinct(), None, None
    for depth in range(SITEMAP_DEPTH + 1):
        seen = level if seen is None else materialize(seen.union(level).distinct(), "sitemaps-seen")
        docs = entries(materialize(documents(level.select("url").distinct()), "sitemap-files") if callable(documents) else documents)
        here = level.join(docs, "url")
        urls = here.where("kind = 'urlset'").select("site", "url", F.posexplode("locs").alias("i", "raw")).select("site", F.lit(depth).alias("d"), F.col("url").alias("map"), "i", U.normalize_url("raw").alias("url"))
        found = urls if found is None else found.union(urls)
        level = materialize(here.where("kind = 'sitemapindex'").select("site", F.explode("locs").alias("url")).distinct().join(seen, ["site", "url"], "left_anti"), "sitemaps")
    found = found.where(F.col("url").isNotNull() & (U.host_of(F.col("url")) == F.col("site")))
    first = found.groupBy("site", "url").agg(F.min(F.struct("d", "map", "i")).alias("at"))
    return first.withColumn("k", F.row_number().over(Window.partitionBy("site").orderBy("at"))).where(F.col("k") <= cap).select("site", "url")


def crawl(seeds: DataFrame, web, max_pages: int = 100, max_depth: int = 3, robots: DataFrame | None = None, sitemap: DataFrame | None = None, agent: str = "webloom", include_subdomains: bool = False) -> tuple[DataFrame, DataFrame]:
    """seeds(site, url). web: a table (url, final_url, status_code, html, content_type, x_robots_tag, redirect_chain, error) of what fetching yields, or a function that fetches such a table for urls(url, delay).

    Returns fetches(site, pos, depth, ...) and skipped(site, url, reason). A wave is the frontier within the
    site's budget of max_pages; failed fetches count. The frontier takes each address once, in crawl order.
    """
    blank = F.array().cast("array<string>")
    first = seeds.select("site", U.normalize_url("url").alias("url"), F.lit(0).alias("depth"), F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).alias("b")).alias("at"))
    if sitemap is not None and max_depth >= 1:
        w = Window.partitionBy("site").orderBy("url")
        first = first.union(sitemap.select("site", "url", F.lit(1).alias("depth"), F.struct(F.lit(1).cast("long").alias("a"), F.row_number().over(w).alias("b")).alias("at")))
    done = seen = skipped = None
    new = first
    while True:
        c = new.where("url is not null").withColumn("key", U.dedup_key(F.col("url")))
        c = c.withColumn("k", F.row_number().over(Window.partitionBy("site", "key").orderBy("depth", "at"))).where("k = 1").drop("k")
        if seen is not None:
            c = c.join(seen, ["site", "key"], "left_anti")
        off = ~U.is_same_domain(F.col("url"), F.concat(F.lit("https://"), F.col("site")), include_subdomains)
        c = allowed(c, robots, agent) if robots is not None else c.withColumn("allowed", F.lit(True))
        c = materialize(c.withColumn("reason", F.when(off, "off_domain").when(~F.col("allowed"), "robots_disallow")), "frontier")
        left = c.where("reason is null")
        used = done.groupBy("site").agg(F.count("*").alias("used")) if done is not None else None
        left = left.join(used, "site", "left") if used is not None else left.withColumn("used", F.lit(0))
        left = left.withColumn("k", F.row_number().over(Window.partitionBy("site").orderBy("depth", "at"))).withColumn("pos", F.coalesce("used", F.lit(0)) + F.col("k") - 1).where(F.col("pos") < max_pages)
        if callable(web):
            left = materialize(left, "wave-urls")
            slow = robots.select("site", host_delay(agent)(F.when(F.col("status_code") < 400, F.col("body"))).alias("delay")) if robots is not None else left.select("site", F.lit(0.0).alias("delay")).distinct()
            answers = materialize(web(left.join(slow, "site", "left").groupBy("url").agg(F.coalesce(F.max("delay"), F.lit(0.0)).alias("delay"))), "wave-answers")
        else:
            answers = web
        got = left.select("site", "pos", "depth", "url", "key").join(answers.withColumnRenamed("url", "web_url"), F.col("url") == F.col("web_url"), "left").drop("web_url")
        got = got.withColumns({"status_code": F.coalesce("status_code", F.lit(0)), "final_url": F.coalesce("final_url", "url"), "error": F.when(F.col("status_code").isNull(), "fetch failed").otherwise(F.col("error")), "x_robots_tag": F.coalesce("x_robots_tag", blank), "redirect_chain": F.coalesce("redirect_chain", blank)})
        got = materialize(got.withColumn("html", F.when(is_html(F.col("content_type")), F.coalesce("html", F.lit(""))).otherwise(F.lit(""))), "wave")
        bad = c.where("reason is not null").select("site", "url", "reason", "key")
        skipped = bad if skipped is None else skipped.union(bad)
        keys = c.select("site", "key")
        seen = materialize(keys if seen is None else seen.union(keys), "seen")
        done = got if done is None else done.union(got)
        grow = got.where(is_ok(F.col("error"), F.col("status_code")) & (F.col("depth") < max_depth))
        if grow.isEmpty():
            break
        new = grow.select("site", "pos", "depth", "final_url", F.posexplode(frontier_links(F.col("html"))).alias("i", "raw"))
        new = new.select("site", U.resolve_url("raw", "final_url").alias("url"), (F.col("depth") + 1).alias("depth"), F.struct(F.col("pos").cast("long").alias("a"), F.col("i").alias("b")).alias("at"))
    return done.drop("key").withColumn("fetched_at", F.current_timestamp()), skipped.groupBy("site", "key").agg(F.min_by("url", "url").alias("url"), F.min("reason").alias("reason")).drop("key")


def crawl_report(fetches: DataFrame, skipped: DataFrame) -> DataFrame:
    ok = is_ok(F.col("error"), F.col("status_code"))
    a = fetches.groupBy("site").agg(F.count("*").alias("pages_fetched"), F.count_if(ok).alias("pages_ok"), F.count_if(ok & is_html(F.col("content_type")) & looks_script_rendered(F.col("html"))).alias("script_rendered"))
    b = skipped.groupBy("site", "reason").count().groupBy("site").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "count")))).alias("skipped"))
    return a.join(b, "site", "left")


def live_crawl(seeds: DataFrame, max_pages: int = 100, max_depth: int = 3, respect_robots: bool = True, use_sitemap: bool = True, include_subdomains: bool = False, agent: str = "webloom", delay: float = 0.2, timeout: float = 10, attempts: int = 3, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Crawl over the network from seeds(site, url): fetches, skipped, and notes(site, robots, sitemap_urls_found). how: get and pause of sources.http.fetched, for tests."""
    ask = lambda raw: lambda urls: fetched(urls, raw, delay, agent, timeout, attempts, **how)
    seeds = materialize(seeds.select("site", U.normalize_url("url").alias("url")).where("url is not null"), "seeds")
    rules = materialize(ask(True)(seeds.select(U.robots_url(F.col("url")).alias("url")).distinct()), "robots-files")
    robots = seeds.select("site", U.robots_url(F.col("url")).alias("url")).distinct().join(rules, "url", "left")
    robots = materialize(robots.groupBy("site").agg(F.min_by(F.struct("status_code", F.decode("body", "utf-8").alias("body")), "url").alias("r")).select("site", "r.*"), "robots")
    listed = materialize(sitemap_urls(sitemap_seeds(seeds, robots), ask(True)), "sitemap-urls") if use_sitemap else None
    pages, skipped = crawl(seeds, ask(False), max_pages, max_depth, robots if respect_robots else None, listed, agent, include_subdomains)
    notes = seeds.select("site").distinct().join(robots.select("site", robots_status(F.col("status_code"), F.col("body")).alias("robots")), "site", "left")
    found = listed.groupBy("site").agg(F.count("*").alias("sitemap_urls_found")) if listed is not None else seeds.select("site", F.lit(0).cast("long").alias("sitemap_urls_found")).distinct()
    return pages, skipped, notes.join(found, "site", "left").withColumn("sitemap_urls_found", F.coalesce("sitemap_urls_found", F.lit(0)))
