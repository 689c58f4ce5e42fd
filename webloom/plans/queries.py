"""The registered queries over the test tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import contact as C
from webloom.functions import text as T
from webloom.functions import urls as U
from webloom.operators import answers as A
from webloom.operators import audit as Q1
from webloom.operators import contacts as Q2
from webloom.operators import validate as V
from webloom.operators.extract import extract, lift_pages
from webloom.sources.crawl import frontier_links, looks_script_rendered
from webloom.storage import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark, sf_dir, one_site: bool = False) -> DataFrame:
    """Extracted pages, by host or as one crawl, parsed once into a written table."""
    lifted = lift_pages(_table(spark, sf_dir, "pages"), F.lit("all") if one_site else None)
    return materialize(extract(lifted), "pages")


def q1_audit(spark, sf_dir):
    """All findings of every host."""
    return Q1.audit(_pages(spark, sf_dir)).select(*Q1.OUT)


def q1_validated(spark, sf_dir):
    """The findings that a new audit of the snapshot confirms."""
    pages = _pages(spark, sf_dir)
    return V.valid_findings(Q1.audit(pages), pages).select(*Q1.OUT)


def q2_nap_report(spark, sf_dir):
    """Name, address and phone of every host, validated."""
    pages = _pages(spark, sf_dir)
    found = materialize(Q2.candidates(pages, Q2.target_business(pages)), "candidates")
    report = V.valid_report(Q2.compare(found, pages.select("site")), pages, found).drop("evidence")
    return report.withColumns({c: F.array_join(c, " | ") for c in ("pages_compared", "values", "normalized_values")})


def q3_answers(spark, sf_dir):
    """Each host asked for the first words of its first page's first block, answers validated."""
    pages = _pages(spark, sf_dir)
    q = A.chunks(pages).groupBy("site").agg(F.min_by("text", "chunk_id").alias("t")).select("site", F.lit(0).alias("qid"), F.substring("t", 1, 120).alias("query"))
    return V.valid_answers(A.answer(pages, q), pages)


def page_fields(spark, sf_dir):
    p = extract(lift_pages(_table(spark, sf_dir, "pages")))
    h1 = F.size(F.element_at("headings", "h1"))
    return p.select(F.col("pos").alias("page_id"), "title", "title_count", h1.alias("h1_count"), F.size("links").alias("n_links"), T.word_count(F.col("text")).alias("n_words"), "content_hash")


def audit_counts(spark, sf_dir):
    """Findings of single pages by check."""
    f = Q1.page_findings(extract(lift_pages(_table(spark, sf_dir, "pages"))))
    return f.groupBy("check_id", "severity").agg(F.count("*").alias("n"))


def audit_short_titles(spark, sf_dir):
    f = Q1.page_findings(extract(lift_pages(_table(spark, sf_dir, "pages"))))
    return f.where("check_id = 'SEO-TITLE-005'").select(F.col("pos").alias("page_id"), "metric", "evidence")


def audit_thin_content(spark, sf_dir):
    f = Q1.page_findings(extract(lift_pages(_table(spark, sf_dir, "pages"))))
    return f.where("check_id = 'SEO-CONTENT-001'").select(F.col("pos").alias("page_id"), "metric", "evidence")


def audit_duplicate_titles(spark, sf_dir):
    """The table as one crawl."""
    return Q1.duplicate_titles(_pages(spark, sf_dir, True)).select(F.col("pos").alias("page_id"), "metric", "evidence")


def site_pages(spark, sf_dir):
    return _table(spark, sf_dir, "pages").groupBy(U.host_of(F.col("url")).alias("site")).agg(F.count("*").alias("n"), F.count_if(U.is_root_path(F.col("url"))).alias("n_root"))


def url_forms(spark, sf_dir):
    u = _table(spark, sf_dir, "pages").select("page_id", U.normalize_url("url").alias("normalized"))
    return u.select("page_id", "normalized", U.dedup_key(F.col("normalized")).alias("dedup_key"))


def frontier(spark, sf_dir):
    p = _table(spark, sf_dir, "pages")
    return p.select("page_id", F.size(frontier_links(F.col("html"))).alias("n_hrefs"), looks_script_rendered(F.col("html")).alias("script_rendered"))


def phones(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(C.phones(F.col("text"))).alias("i", "raw"))
    return d.select("doc_id", F.col("i").cast("int").alias("i"), "raw", C.normalize_phone(F.col("raw")).alias("normalized"))


def tokens(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", T.tokenize(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("digest"))


def name_forms(spark, sf_dir):
    n = _table(spark, sf_dir, "customer").select("c_custkey", C.normalize_name(F.col("c_name")).alias("name"))
    return n.withColumn("bare", C.strip_legal_suffix(F.col("name")))


def _documents_as_chunks(spark, sf_dir):
    c = _table(spark, sf_dir, "documents").select(F.lit("all").alias("site"), F.col("doc_id").alias("chunk_id"), "text")
    q = _table(spark, sf_dir, "benchmark").select(F.lit("all").alias("site"), F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return c, q


def bm25_scores(spark, sf_dir):
    """Every benchmark text as a question to all documents: the documents that share a token, by score."""
    c, q = _documents_as_chunks(spark, sf_dir)
    s = A.bm25(c, q)
    return s.groupBy("qid").agg(F.count("*").alias("n_docs"), F.round(F.sum("score"), 4).alias("total"), F.round(F.max("score"), 6).alias("best"))


def bm25_top(spark, sf_dir):
    """The 15 best documents for each question."""
    c, q = _documents_as_chunks(spark, sf_dir)
    return A.top_k(c, q).select("qid", F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"))


QUERIES = {f.__name__: f for f in (q1_audit, q1_validated, q2_nap_report, q3_answers, page_fields, audit_counts, audit_short_titles, audit_thin_content, audit_duplicate_titles, site_pages, url_forms, frontier, phones, tokens, name_forms, bm25_scores, bm25_top)}

_UNESCAPE = "replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_STRIP = r"regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<![^>]*>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
_FIELDS = rf"""
p AS (
  SELECT page_id, html,
         trim(regexp_replace({_UNESCAPE.format(_STRIP)}, '\s+', ' ', 'g')) AS text,
         CASE WHEN regexp_matches(html, '(?i)<title') THEN trim(regexp_replace({_UNESCAPE.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '\s+', ' ', 'g')) END AS title,
         len(regexp_extract_all(html, '(?i)<title')) AS title_count,
         len(regexp_extract_all(html, '(?i)<h1\b')) AS h1_count,
         len(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref="[^"#]')) AS n_links
  FROM (SELECT page_id, coalesce(html, '') AS html FROM pages)
), f AS (
  SELECT *, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) END AS n_words FROM p
)"""
_QUOTE = "'\"' || CASE WHEN length({0}) <= 200 THEN {0} ELSE left({0}, 200) || '...' END || '\"'"
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_TOKENS = rf"""list_transform(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN ({_STOP})),
  lambda w: CASE WHEN length(w) > 4 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END)"""
_BM25 = rf"""
WITH c AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM c),
tf AS (SELECT doc_id, dl, token, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS token FROM c) GROUP BY ALL),
i0 AS (SELECT token, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, s GROUP BY token, n),
idf AS (SELECT token, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM i0) ELSE raw END AS idf FROM i0),
q AS (SELECT qid, token, count(*) AS times FROM (SELECT item_id AS qid, unnest({_TOKENS}) AS token FROM benchmark) GROUP BY ALL),
r AS (SELECT qid, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN q USING (token) JOIN idf USING (token), s GROUP BY qid, doc_id)
"""
_HOST = r"regexp_replace(regexp_extract(lower(url), '^https?://(?:[^/?#@]*@)?([^/?#:]*)', 1), '^www\.', '')"
_PATH = r"regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"

_ADDRESS = C.ADDRESS.replace("(?iU)", "(?i)").replace("'", "''")
_COPYRIGHT = r"(?:©\s*(?:\d{4}\s*(?:[-–]\s*\d{4})?\s*)?|(?i:copyright|\(c\))\s+\d{4}\s*(?:[-–]\s*\d{4})?\s*)(?:(?i:by)\s+)?\p{Lu}"
_PHONE_SHAPED = r"""list_filter(regexp_extract_all(text, '\+?\d[\d\s().\-]{6,20}\d'), lambda c: regexp_matches(c, '[()\-.]|^\+') AND NOT regexp_matches(trim(c), '^\d{4}\s*-\s*\d{2}\s*-\s*\d{2}$')
          AND (len(regexp_extract_all(c, '\d+')) >= 2 OR c LIKE '+%') AND (len(list_filter(regexp_extract_all(c, '\d+'), lambda g: length(g) = 4)) < 2 OR contains(c, '(') OR c LIKE '+%')
          AND len(list_filter(regexp_extract_all(c, '\d+'), lambda g: length(g) = 1)) <= 1)"""


def _finding(check: str, metric: str, severity: str, evidence: str, fix: str, where: str) -> str:
    return f"SELECT site, '{metric}' AS metric, url AS page, '{severity}' AS severity, {evidence} AS evidence, '{fix}' AS suggested_fix, 'SEO-{check}' AS check_id FROM a WHERE {where}"


def _shared_sql(check: str, metric: str, value: str, evidence: str, fix: str) -> str:
    every = f"list(struct_pack(u := url, i := page_id) ORDER BY page_id) OVER (PARTITION BY site, {value} ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    others = f"list_transform(list_filter(every, lambda x: x.u <> url), lambda x: x.u)"
    rows = f"(SELECT *, {others} AS others, len(every) AS n FROM (SELECT *, {every} AS every FROM a WHERE coalesce({value}, '') <> '')) WHERE n > 1"
    return f"SELECT site, '{metric}', url, 'warning', {evidence} || len(others) || ' other page(s): ' || array_to_string(others[1:3], ', '), '{fix}', 'SEO-{check}' FROM {rows}"


# the checks that pages without descriptions, canonical links, robots and image tags can meet; plans.built has pages for all others
_AUDIT = f"WITH {_FIELDS}, a AS (SELECT f.*, url, {_HOST} AS site FROM f JOIN (SELECT page_id, url FROM pages) u USING (page_id)) " + " UNION ALL ".join(
    [
        _finding("TITLE-001", "missing_title", "critical", "'No <title> element is present in the document <head>.'", "Give the page a <title> of its own, 30 to 60 characters long.", "title IS NULL"),
        _finding("TITLE-002", "empty_title", "critical", "'A <title> element is present but contains no text.'", "Fill in the <title>: say in a few words what only this page offers.", "title = ''"),
        _finding("TITLE-004", "title_too_long", "info", f"'<title> is ' || length(title) || ' characters, over the 60-character display limit: ' || {_QUOTE.format('title')}", "Cut the title down to 60 characters; result lists show no more.", "length(title) > 60"),
        _finding("TITLE-005", "title_too_short", "info", f"'<title> is only ' || length(title) || ' characters: ' || {_QUOTE.format('title')}", "Say more in the title: 30 characters at least, with what sets this page apart.", "length(title) BETWEEN 1 AND 29"),
        _finding("META-001", "missing_meta_description", "info", "'No <meta name=\"description\"> element is present in the document <head>.'", "Describe the page in a description meta tag of 70 to 160 characters.", "NOT regexp_matches(html, '(?i)<meta[^>]*name=.?description')"),
        _finding("CANON-001", "missing_canonical", "info", "'No <link rel=\"canonical\"> element is present in the document <head>.'", "Name the page''s own address in a canonical link, so that its variants count as one.", "NOT regexp_matches(html, '(?i)rel=.?canonical')"),
        _finding("HEAD-001", "missing_h1", "info", "'The page contains no <h1> element.'", "Say in one <h1> what the page is about.", "h1_count = 0"),
        _finding("CONTENT-001", "thin_content", "info", "'The page has ' || n_words || ' words of visible text, below the 150-word threshold used here.'", "Add to the text if the page is meant to be found; pages that only serve a purpose, such as a login, may stay short.", "n_words < 150"),
        _finding("SOCIAL-001", "missing_open_graph", "info", "'Open Graph tags absent from <head>: og:description, og:image, og:title.'", "Add these og: meta tags; without them a shared link shows no preview.", "NOT regexp_matches(html, '(?i)property=.?og:')"),
        _shared_sql("DUP-001", "duplicate_title", "title", f"'This page''s <title> ' || {_QUOTE.format('title')} || ' is also used on '", "Change the titles so that no two pages share one."),
        _shared_sql("DUP-003", "duplicate_content", "text", "'This page''s visible text is identical to '", "Merge these pages, or let canonical links name the one that is to be indexed."),
    ]
)
_NAP = rf"""WITH {_FIELDS}, a AS (SELECT f.page_id, f.text, url, {_HOST} AS site FROM f JOIN (SELECT page_id, url FROM pages) u USING (page_id)),
    c AS (SELECT site, page_id, url, unnest(l) AS raw, unnest(range(len(l))) AS i FROM (SELECT *, {_PHONE_SHAPED} AS l FROM a)),
    n AS (SELECT *, CASE WHEN length(regexp_replace(raw, '\D', '', 'g')) BETWEEN 7 AND 15 THEN right(regexp_replace(raw, '\D', '', 'g'), 10) ELSE '' END AS v FROM c),
    o AS (SELECT * FROM (SELECT * FROM n WHERE v <> '' QUALIFY row_number() OVER (PARTITION BY site, page_id, url, v ORDER BY i) = 1) QUALIFY row_number() OVER (PARTITION BY site, page_id, url ORDER BY i) <= 12),
    g AS (SELECT site, v, count(*) AS n, min(page_id * 1000 + i) AS first, arg_min(raw, page_id * 1000 + i) AS raw FROM o GROUP BY ALL),
    h AS (SELECT site, string_agg(raw, ' | ' ORDER BY first) AS raws, string_agg(v, ' | ' ORDER BY first) AS vs, count(*) AS forms, max(n) AS most, CAST(sum(n) AS BIGINT) AS total FROM g GROUP BY site),
    u AS (SELECT site, string_agg(url, ' | ' ORDER BY first) AS urls FROM (SELECT site, url, min(page_id * 1000 + i) AS first FROM o GROUP BY ALL) GROUP BY site),
    s AS (SELECT site, bool_or(regexp_matches(text, '{_ADDRESS}')) AS place, bool_or(regexp_matches(text, '{_COPYRIGHT}')) AS named FROM a GROUP BY site)
    SELECT site, 'phone' AS field, coalesce(urls, '') AS pages_compared, coalesce(raws, '') AS "values", coalesce(vs, '') AS normalized_values, coalesce(round(most / total, 4), 0.0) AS confidence,
      CASE WHEN total IS NULL THEN 'insufficient_data' WHEN forms = 1 THEN 'consistent' ELSE 'inconsistent' END AS verdict, coalesce(most, 0) AS majority_count, coalesce(total, 0) AS total
    FROM s LEFT JOIN h USING (site) LEFT JOIN u USING (site)
    UNION ALL SELECT site, unnest(['name', 'address']), '', '', '', 0.0, unnest([CASE WHEN NOT named THEN 'insufficient_data' END, CASE WHEN NOT place THEN 'insufficient_data' END]), 0, 0 FROM s"""

ORACLE = {
    "q1_audit": _AUDIT,
    "q1_validated": _AUDIT,
    "q2_nap_report": _NAP,
    "page_fields": f"WITH {_FIELDS} SELECT page_id, title, CAST(title_count AS INT) AS title_count, CAST(h1_count AS INT) AS h1_count, CAST(n_links AS INT) AS n_links, CAST(n_words AS INT) AS n_words, sha256(text) AS content_hash FROM f",
    "audit_counts": f"""WITH {_FIELDS}, k AS (
        SELECT CASE WHEN title IS NULL THEN 'SEO-TITLE-001' WHEN title = '' THEN 'SEO-TITLE-002' WHEN length(title) > 60 THEN 'SEO-TITLE-004' WHEN length(title) < 30 THEN 'SEO-TITLE-005' END AS check_id,
               CASE WHEN coalesce(title, '') = '' THEN 'critical' ELSE 'info' END AS severity FROM f
        UNION ALL SELECT 'SEO-META-001', 'info' FROM f UNION ALL SELECT 'SEO-CANON-001', 'info' FROM f UNION ALL SELECT 'SEO-SOCIAL-001', 'info' FROM f
        UNION ALL SELECT 'SEO-CONTENT-001', 'info' FROM f WHERE n_words < 150
        UNION ALL SELECT 'SEO-HEAD-001', 'info' FROM f WHERE h1_count = 0 UNION ALL SELECT 'SEO-HEAD-002', 'info' FROM f WHERE h1_count > 1)
        SELECT check_id, severity, count(*) AS n FROM k WHERE check_id IS NOT NULL GROUP BY ALL""",
    "audit_short_titles": f"WITH {_FIELDS} SELECT page_id, 'title_too_short' AS metric, '<title> is only ' || length(title) || ' characters: ' || {_QUOTE.format('title')} AS evidence FROM f WHERE title <> '' AND length(title) < 30",
    "audit_thin_content": f"WITH {_FIELDS} SELECT page_id, 'thin_content' AS metric, 'The page has ' || n_words || ' words of visible text, below the 150-word threshold used here.' AS evidence FROM f WHERE n_words < 150",
    "audit_duplicate_titles": f"""WITH {_FIELDS}, g AS (SELECT title, list(struct_pack(id := page_id, url := url) ORDER BY page_id) AS l FROM f JOIN (SELECT page_id, url FROM pages) u USING (page_id) WHERE title <> '' GROUP BY title HAVING count(*) > 1),
        o AS (SELECT page_id, title, list_transform(list_filter(l, lambda x: x.url <> u.url), lambda x: x.url) AS others FROM f JOIN g USING (title) JOIN (SELECT page_id, url FROM pages) u USING (page_id))
        SELECT page_id, 'duplicate_title' AS metric, 'This page''s <title> ' || {_QUOTE.format('title')} || ' is also used on ' || len(others) || ' other page(s): ' || array_to_string(others[1:3], ', ') AS evidence FROM o""",
    "site_pages": f"SELECT {_HOST} AS site, count(*) AS n, count(*) FILTER (WHERE {_PATH} IN ('', '/')) AS n_root FROM pages GROUP BY 1",
    "url_forms": rf"""WITH u AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS s, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS h, {_PATH} AS p, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages),
        n AS (SELECT page_id, s, h, CASE WHEN p = '' THEN '/' ELSE p END AS p, array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_|gclid=|fbclid=)'))), '&') AS q FROM u),
        t AS (SELECT *, CASE WHEN q = '' THEN '' ELSE '?' || q END AS tail FROM n)
        SELECT page_id, s || '://' || h || p || tail AS normalized, regexp_replace(h, '^www\.', '') || CASE WHEN p = '/' THEN p ELSE regexp_replace(p, '/+$', '') END || tail AS dedup_key FROM t""",
    "frontier": r"""SELECT page_id, CAST(len(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["''][^"''#]')) AS INT) AS n_hrefs,
        length(trim(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) < 200 AND regexp_matches(html, '(?i)<script\b') AS script_rendered FROM pages""",
    "phones": r"""WITH c AS (SELECT doc_id, regexp_extract_all(text, '\+?\d[\d\s().\-]{6,20}\d') AS l FROM documents),
        k AS (SELECT doc_id, list_filter(l, lambda c: regexp_matches(c, '[()\-.]|^\+') AND NOT regexp_matches(trim(c), '^\d{4}\s*-\s*\d{2}\s*-\s*\d{2}$')
          AND (len(regexp_extract_all(c, '\d+')) >= 2 OR c LIKE '+%')
          AND (len(list_filter(regexp_extract_all(c, '\d+'), lambda g: length(g) = 4)) < 2 OR contains(c, '(') OR c LIKE '+%')
          AND len(list_filter(regexp_extract_all(c, '\d+'), lambda g: length(g) = 1)) <= 1) AS l FROM c),
        e AS (SELECT doc_id, unnest(l) AS raw, unnest(range(len(l))) AS i FROM k)
        SELECT doc_id, CAST(i AS INT) AS i, raw, CASE WHEN length(regexp_replace(raw, '\D', '', 'g')) BETWEEN 7 AND 15 THEN right(regexp_replace(raw, '\D', '', 'g'), 10) ELSE '' END AS normalized FROM e""",
    "tokens": f"WITH t AS (SELECT doc_id, {_TOKENS} AS t FROM documents) SELECT doc_id, CAST(len(t) AS INT) AS n_tokens, CAST(len(list_distinct(t)) AS INT) AS n_distinct, md5(array_to_string(t, ' ')) AS digest FROM t",
    "name_forms": r"""WITH n AS (SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9_]+', ' ', 'g')) AS name FROM customer)
        SELECT c_custkey, name, trim(regexp_replace(name, '((^| )(inc|incorporated|llc|llp|lp|ltd|limited|plc|pvt|private|corp|corporation|co|company|gmbh|bv|nv|ag|sa|srl|pty|pte))+$', '')) AS bare FROM n""",
    "bm25_scores": _BM25 + "SELECT qid, count(*) AS n_docs, round(sum(score), 4) AS total, round(max(score), 6) AS best FROM r GROUP BY qid",
    "bm25_top": _BM25 + ", a AS (SELECT qid, doc_id, score FROM r UNION ALL SELECT qid, c.doc_id, 0.0 FROM (SELECT DISTINCT qid FROM q) q0, c WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.qid = q0.qid AND r.doc_id = c.doc_id)) SELECT qid, doc_id, round(score, 6) AS score FROM a QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) <= 15",
}
