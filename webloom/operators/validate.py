"""Validation by recomputation: what can't be derived again from the page snapshot is dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.text import normalize_whitespace
from webloom.functions.urls import link_key
from webloom.operators.audit import KEY, audit
from webloom.operators.contacts import candidates, compare, normalized, target_business


def valid_findings(findings: DataFrame, pages: DataFrame, fetches: DataFrame | None = None) -> DataFrame:
    """Findings with every field filled whose key a new audit yields.

    Without fetches the new audit sees no failed targets or redirects, so findings about those go.
    """
    again = audit(pages, fetches).select("site", *KEY).distinct()
    full = findings
    for c in KEY:
        full = full.where(normalize_whitespace(F.col(c)) != "")
    return full.join(again, ["site", *KEY], "left_semi")


def valid_report(report: DataFrame, pages: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Fields whose evidence is found again and gives the same verdict. found: the candidates of the pages, if they stand written already."""
    ev = report.select("site", "field", F.posexplode("evidence").alias("ord", "e")).select("site", "field", "ord", "e.*")
    found = found if found is not None else candidates(pages, target_business(pages))
    found = found.select("site", "field", "page", "raw_value", "source").distinct()
    first = pages.groupBy("site", F.col("final_url").alias("page")).agg(F.min_by("text", "pos").alias("text"))
    bad_norm = ev.where(~normalized(F.col("field"), F.col("raw_value")).eqNullSafe(F.col("normalized_value")))
    llm = ev.where("source = 'llm'").join(first, ["site", "page"], "left").where(~F.coalesce(F.contains("text", "raw_value"), F.lit(False)))
    lost = ev.where("source <> 'llm'").join(found, ["site", "field", "page", "raw_value", "source"], "left_anti")
    bad = bad_norm.select("site", "field").union(llm.select("site", "field")).union(lost.select("site", "field")).distinct()
    again = compare(ev.withColumn("pos", F.col("ord").cast("long")).select("site", "pos", "page", "ord", "field", "raw_value", "normalized_value", "source"), report.select("site"))
    cols = ["pages_compared", "values", "normalized_values", "confidence", "verdict"]
    same = again.select("site", "field", F.struct(*cols).alias("again"))
    out = report.join(bad, ["site", "field"], "left_anti").join(same, ["site", "field"])
    return out.where(F.struct(*cols).eqNullSafe(F.col("again"))).select(*report.columns)


def _bare(excerpt: Column) -> Column:
    t = normalize_whitespace(excerpt)
    return F.when(t.rlike("(?s)^([\"'“‘]).*[\"'”’]$") & (F.char_length(t) > 1), normalize_whitespace(F.substr(t, F.lit(2), F.char_length(t) - 2))).otherwise(t)


def source_spans(answers: DataFrame, pages: DataFrame) -> DataFrame:
    """answers with char_start and char_end: where the page's text has the excerpt, white space and outer quotes aside; null if nowhere."""
    texts = pages.select("site", F.explode(F.array_distinct(F.array("url", "final_url", link_key(F.col("url")), link_key(F.col("final_url"))))).alias("key"), "pos", "text")
    texts = texts.groupBy("site", "key").agg(F.min_by("text", "pos").alias("page_text"))
    exact = texts.select("site", F.col("key").alias("url"), F.col("page_text").alias("t1"))
    loose = texts.select("site", F.col("key").alias("k"), F.col("page_text").alias("t2"))
    a = answers.withColumn("k", link_key(F.col("url"))).join(exact, ["site", "url"], "left").join(loose, ["site", "k"], "left")
    t, whole, bare = F.coalesce("t1", "t2"), normalize_whitespace(F.col("excerpt")), _bare(F.col("excerpt"))
    at = lambda e: F.when(e != "", F.nullif(F.position(e, t), F.lit(0)))
    start = F.coalesce(at(whole), at(bare)) - 1
    size = F.when(at(whole).isNotNull(), F.char_length(whole)).otherwise(F.char_length(bare))
    return a.select(*answers.columns, start.cast("int").alias("char_start"), (start + size).cast("int").alias("char_end"))


def valid_answers(answers: DataFrame, pages: DataFrame) -> DataFrame:
    """Answers whose excerpt isn't on the page become the null answer; a null answer stands."""
    a = source_spans(answers, pages)
    ok = F.col("url").isNotNull() & F.col("excerpt").isNotNull() & F.col("char_start").isNotNull()
    cols = [F.when(ok, F.col(c)).alias(c) if c in ("url", "excerpt") else F.when(ok, "exact_substring").otherwise("none").alias(c) if c == "match_type" else F.col(c) for c in answers.columns]
    return a.select(*cols)
