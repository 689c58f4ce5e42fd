"""Audits of pages as they arrive: checks of single pages are stateless, so a stream of fetches is a stream of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.operators.audit import page_findings
from webloom.operators.extract import extract


def stream_findings(fetches: DataFrame) -> DataFrame:
    """fetches: a streaming DataFrame with the columns of lift_pages."""
    return page_findings(extract(fetches))


def new_contents(fetches: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Pages whose text no earlier page of their site had, within the watermark; needs fetched_at."""
    pages = extract(fetches).withWatermark("fetched_at", delay)
    return pages.dropDuplicatesWithinWatermark(["site", "content_hash"])


def finding_counts(fetches: DataFrame, window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Pages by site and window of arrival, with those of thin content."""
    pages = extract(fetches).withWatermark("fetched_at", delay)
    thin = F.size(F.filter(F.split("text", " "), lambda w: w != "")) < 150
    return pages.groupBy("site", F.window("fetched_at", window)).agg(F.count("*").alias("pages"), F.count_if(thin).alias("thin"))
