"""Fetched pages to extracted pages: one parse of each page in Arrow batches, everything else in columns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import text as T
from webloom.functions import urls as U
from webloom.operators.markup import extract_page

PAGE = """struct<text:string, title:string, meta_description:string, canonical:string, html_robots_meta:array<string>, headings:map<string,array<string>>,
 images:array<struct<src:string,alt:string>>, links:array<struct<href:string,anchor_text:string>>, structured_data:array<string>, microdata:array<string>, og:array<string>,
 values:array<struct<source:string,block_name:string,field:string,raw:string>>, blocks:array<struct<text:string,start:int,end:int>>,
 title_count:int, meta_description_count:int, canonical_count:int>"""
AT_ONCE = 64  # pages
_S = pa.string()
_ARROW = pa.struct(
    [
        ("text", _S),
        ("title", _S),
        ("meta_description", _S),
        ("canonical", _S),
        ("html_robots_meta", pa.list_(_S)),
        ("headings", pa.map_(_S, pa.list_(_S))),
        ("images", pa.list_(pa.struct([("src", _S), ("alt", _S)]))),
        ("links", pa.list_(pa.struct([("href", _S), ("anchor_text", _S)]))),
        ("structured_data", pa.list_(_S)),
        ("microdata", pa.list_(_S)),
        ("og", pa.list_(_S)),
        ("values", pa.list_(pa.struct([("source", _S), ("block_name", _S), ("field", _S), ("raw", _S)]))),
        ("blocks", pa.list_(pa.struct([("text", _S), ("start", pa.int32()), ("end", pa.int32())]))),
        ("title_count", pa.int32()),
        ("meta_description_count", pa.int32()),
        ("canonical_count", pa.int32()),
    ]
)


def lift_pages(pages: DataFrame, site: Column | None = None) -> DataFrame:
    """pages(page_id, url, html) as fetches that all succeeded; pos is the crawl order."""
    none = F.array().cast("array<string>")
    return pages.select(
        (site if site is not None else U.host_of(F.col("url"))).alias("site"),
        F.col("page_id").cast("long").alias("pos"),
        "url",
        F.col("url").alias("final_url"),
        F.lit(200).alias("status_code"),
        F.lit(None).cast("timestamp").alias("fetched_at"),
        F.coalesce("html", F.lit("")).alias("html"),
        F.lit(0).alias("depth"),
        F.lit("text/html").alias("content_type"),
        none.alias("x_robots_tag"),
        none.alias("redirect_chain"),
        F.lit(None).cast("string").alias("error"),
    )


def is_html(content_type: Column) -> Column:
    ct = F.lower(F.btrim(F.coalesce(content_type, F.lit(""))))
    return (ct == "") | ct.startswith("text/html") | ct.startswith("application/xhtml+xml")


def is_ok(error: Column, status: Column) -> Column:
    return error.isNull() & status.between(200, 299)


def header_directives(tags: Column) -> Column:
    """Directives of X-Robots-Tag headers, a leading bot name left out."""
    bare = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda v: F.regexp_replace(v, r"(?s)^\s*[a-zA-Z][\w-]*\s*:\s*(.*)$", "$1"))
    words = F.transform(F.flatten(F.transform(bare, lambda v: F.split(v, ","))), lambda d: F.lower(F.btrim(d)))
    return F.array_distinct(F.filter(words, lambda d: d != ""))


def extract(fetches: DataFrame) -> DataFrame:
    """Successful HTML fetches with everything extracted from them."""
    cols = ["site", "pos", "url", "final_url", "status_code", "fetched_at", "html", "x_robots_tag"]
    kept = fetches.where(is_ok(F.col("error"), F.col("status_code")) & is_html(F.col("content_type"))).select(*cols)

    def run(batches):
        # a worker holds what was found on AT_ONCE pages, whatever the size of a batch
        for b in (batch.slice(i, AT_ONCE) for batch in batches for i in range(0, batch.num_rows, AT_ONCE)):
            # map columns take lists of pairs
            rows = [extract_page(h, u) for h, u in zip(b.column(6).to_pylist(), b.column(3).to_pylist(), strict=True)]
            rows = [r | {"headings": list(r["headings"].items())} for r in rows]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, type=_ARROW)], names=[*cols, "x"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema) + f", x {PAGE}"
    p = kept.mapInArrow(run, schema).select(*cols, "x.*")
    internal = F.transform("links", lambda k: F.struct(k["href"].alias("href"), k["anchor_text"].alias("anchor_text"), U.is_same_domain(k["href"], F.col("final_url")).alias("is_internal")))
    return p.withColumns({"links": internal, "robots_meta": F.array_distinct(F.concat("html_robots_meta", header_directives(F.col("x_robots_tag")))), "content_hash": T.content_hash(F.col("text"))}).drop("x_robots_tag")
