"""From fetches to audit, contact report and answers, validated, as tables or JSON files; also a command line."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators import answers as A
from webloom.operators import audit as Q1
from webloom.operators import contacts as Q2
from webloom.operators import hooks
from webloom.operators import validate as V
from webloom.functions import urls as U
from webloom.operators.extract import extract, lift_pages
from webloom.sources.crawl import crawl_report, live_crawl
from webloom.storage import materialize

FILES = {"audit": "audit.json", "nap_report": "nap_report.json", "answer": "answer.json"}


@dataclass
class Result:
    """The tables of a run; a part that was not asked for is None."""

    pages: DataFrame
    findings: DataFrame | None = None
    report: DataFrame | None = None
    answers: DataFrame | None = None


def run(fetches: DataFrame, questions: DataFrame | None = None, q1: bool = True, q2: bool = True, q3: bool = True, generate: Callable[[str], str] | None = None, strict_reference_validation: bool = True) -> Result:
    """fetches as of sources.crawl or operators.extract.lift_pages; questions(site, qid, query).

    Pages are parsed once, into a written table that all parts read. With strict_reference_validation,
    findings that need fetches (failed targets, redirects) do not outlive validation.
    """
    pages = materialize(extract(fetches), "pages")
    out = Result(pages)
    if q2:
        found = materialize(Q2.candidates(pages, Q2.target_business(pages)), "candidates")
        out.report = V.valid_report(Q2.compare(found, pages.select("site")), pages, found)
    if q1:
        found = Q1.audit(pages, fetches)
        if generate:
            found = hooks.suggest_fixes(found, generate)
        out.findings = V.valid_findings(found, pages, None if strict_reference_validation else fetches)
    if q3 and questions is not None:
        out.answers = V.valid_answers(A.answer(pages, questions), pages)
    return out


def run_site(spark: SparkSession, url: str, question: str | None = None, q1: bool = True, q2: bool = True, q3: bool = True, generate: Callable[[str], str] | None = None, **crawl_options) -> tuple[Result, DataFrame]:
    """Crawl from url over the network, then run(); also the notes of the crawl: pages, skip reasons, robots and sitemaps."""
    seeds = spark.createDataFrame([(url,)], "url string").select(U.host_of(F.col("url")).alias("site"), "url")
    fetches, skipped, notes = live_crawl(seeds, **crawl_options)
    fetches = materialize(fetches, "fetches")
    questions = seeds.select("site", F.lit(0).alias("qid"), F.lit(question).alias("query")) if question else None
    return run(fetches, questions, q1, q2, q3, generate), crawl_report(fetches, skipped).join(notes, "site", "full")


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


def skip_counts(skipped: DataFrame) -> DataFrame:
    return skipped.groupBy("reason").agg(F.count("*").alias("n"))


def write_tables(result: Result, folder: str) -> None:
    """Sink for many sites: JSON lines by site."""
    for name, df in (("findings", result.findings), ("nap_report", result.report), ("answers", result.answers)):
        if df is not None:
            df.write.mode("overwrite").partitionBy("site").json(f"{folder}/{name}")


def write_site(result: Result, folder: str, site: str) -> dict[str, str]:
    """The three files of one site. They hold one site's findings, which one document has to hold anyway."""
    parts = {
        "audit": Q1.to_audit_entries(Q1.ordered(result.findings.where(F.col("site") == site))) if result.findings is not None else None,
        "nap_report": Q2.to_report_entries(result.report.where(F.col("site") == site).orderBy(F.expr("array_position(array('name', 'address', 'phone'), field)"))) if result.report is not None else None,
        "answer": A.to_answer_json(result.answers.where(F.col("site") == site)) if result.answers is not None else None,
    }
    Path(folder).mkdir(parents=True, exist_ok=True)
    out = {}
    for name, df in parts.items():
        if df is not None:
            rows = [r.asDict(True) for r in df.collect()]
            path = Path(folder) / FILES[name]
            path.write_text(json.dumps(rows[0] if name == "answer" and len(rows) == 1 else rows, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")
            out[name] = str(path)
    return out


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="webloom", description="Audit a table of pages.")
    p.add_argument("pages", help="Parquet with page_id, url, html; or the address of a site to crawl")
    p.add_argument("out")
    p.add_argument("--question")
    p.add_argument("--max-pages", type=int, default=100)
    p.add_argument("--max-depth", type=int, default=3)
    p.add_argument("--timeout", type=float, default=10)
    for q in ("q1", "q2", "q3"):
        p.add_argument(f"--{q}", action="store_true", help="run only the parts that are named")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("webloom").getOrCreate()
    every = not (a.q1 or a.q2 or a.q3)
    if a.pages.startswith(("http://", "https://")):
        result, notes = run_site(spark, a.pages, a.question, every or a.q1, every or a.q2, every or a.q3, max_pages=a.max_pages, max_depth=a.max_depth, timeout=a.timeout)
        write_tables(result, a.out)
        notes.show(truncate=False)
        return 0
    try:
        pages = spark.read.parquet(a.pages)
    except Exception as e:  # noqa: BLE001
        print(f"cannot read {a.pages}: {e}", file=sys.stderr)
        return 2
    fetches = lift_pages(pages)
    questions = fetches.select("site").distinct().select("site", F.lit(0).alias("qid"), F.lit(a.question).alias("query")) if a.question else None
    result = run(fetches, questions, every or a.q1, every or a.q2, every or a.q3)
    write_tables(result, a.out)
    if result.findings is not None:
        severity_counts(result.findings).show()
    return 0


if __name__ == "__main__":
    sys.exit(main())
