"""Places where a caller's own text generator may help: it can rephrase a fix, reject a candidate or point at literal text, and nothing else."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.operators.contacts import normalized
from webloom.operators.validate import valid_answers

Generate = Callable[[str], str]
MAX_FIX = 400
BOUND = 3000


def _asking(generate: Generate) -> Callable[[Column], Column]:
    """A column function; a generator that raises answers null."""

    def ask(prompts: pd.Series) -> pd.Series:
        out = []
        for p in prompts:
            try:
                out.append(generate(p) if p is not None else None)
            except Exception:  # noqa: BLE001
                out.append(None)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(ask, "string")


def suggest_fixes(findings: DataFrame, generate: Generate, template: str = "Rewrite this fix for {metric} on {page} ({evidence}): {fix}") -> DataFrame:
    """findings with suggested_fix rephrased where the answer is usable; no other column can change."""
    prompt = F.lit(template)
    for name, col in (("metric", "metric"), ("page", "page"), ("evidence", "evidence"), ("fix", "suggested_fix")):
        prompt = F.replace(prompt, F.lit("{" + name + "}"), F.col(col))
    told = F.btrim(_asking(generate)(prompt))
    out = findings.withColumn("_told", told)
    ok = (F.col("_told") != "") & (F.char_length("_told") <= MAX_FIX) & (F.col("_told") != F.col("evidence"))
    return out.withColumn("suggested_fix", F.when(ok, F.col("_told")).otherwise(F.col("suggested_fix"))).drop("_told")


def filter_candidates(values: DataFrame, decide: Generate, context: str = "") -> DataFrame:
    """values without those that decide answers with a text that begins with no."""
    prompt = F.concat(F.lit(f"{context}\nIs this the business's own "), "field", F.lit("? "), "raw_value")
    return values.withColumn("_told", _asking(decide)(prompt)).where("_told is null or not lower(btrim(_told)) like 'no%'").drop("_told")


def parse_reply(reply: str | None) -> dict:
    """The JSON object in a reply: thoughts, code fences and talk around it left out."""
    t = re.sub(r"<think>.*?</think>", "", reply or "", flags=re.S)
    t = re.sub(r"^\s*```\w*|```\s*$", "", t.strip())
    a, b = t.find("{"), t.rfind("}")
    try:
        v = json.loads(t[a : b + 1]) if 0 <= a < b else {}
    except ValueError:
        v = {}
    return v if isinstance(v, dict) else {}


def recover_values(pages: DataFrame, fields: list[str], generate: Generate) -> DataFrame:
    """(site, pos, page, ord, field, raw_value, normalized_value, source='llm'): values that are literally in the page's text."""
    t = F.col("text")
    bound = F.when(F.char_length(t) <= 2 * BOUND, t).otherwise(F.concat(F.substring(t, 1, BOUND), F.lit(" ... "), F.right(t, F.lit(BOUND))))
    told = _asking(generate)(F.concat(F.lit(f"Give {', '.join(fields)} of the business as JSON.\n"), bound))

    @F.pandas_udf("map<string,string>")
    def parsed(s: pd.Series) -> pd.Series:
        return s.map(lambda r: {k: v for k, v in parse_reply(r).items() if k in fields and isinstance(v, str)})

    v = pages.select("site", "pos", F.col("final_url").alias("page"), "text", F.explode(parsed(told)).alias("field", "raw_value"))
    v = v.where((F.btrim("raw_value") != "") & F.contains("text", "raw_value"))
    return v.select("site", "pos", "page", F.lit(0).alias("ord"), "field", "raw_value", normalized(F.col("field"), F.col("raw_value")).alias("normalized_value"), F.lit("llm").alias("source")).where("normalized_value <> ''")


def generated_answers(ranked: DataFrame, pages: DataFrame, generate: Generate) -> DataFrame:
    """ranked(site, qid, query, rank, url, text): answers the generator points at; what isn't literally on the page becomes null."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "url", "text"))), lambda x: F.concat(F.lit("["), x["url"], F.lit("] "), x["text"])), "\n")
    q = ranked.groupBy("site", "qid", "query").agg(listed.alias("listed"))

    @F.pandas_udf("struct<url:string,excerpt:string>")
    def parsed(s: pd.Series) -> pd.DataFrame:
        rows = [parse_reply(r) for r in s]
        keep = [isinstance(r.get("excerpt"), str) and isinstance(r.get("url"), str) and len(r["excerpt"]) <= 600 for r in rows]
        return pd.DataFrame({k: [r.get(k) if ok else None for r, ok in zip(rows, keep, strict=True)] for k in ("url", "excerpt")}, dtype=object)

    a = q.withColumn("a", parsed(_asking(generate)(F.concat(F.lit("Answer with JSON url and excerpt, copied literally.\n"), "query", F.lit("\n"), "listed"))))
    return valid_answers(a.select("site", "qid", "query", "a.url", "a.excerpt", F.lit("none").alias("match_type")), pages)
