"""Document quality rules with verdicts on whole hosts, in DataFrame operations only.

A document fails by its own figures (base_failed), or because its host does: failures are summed by
host, each host's rate is drawn towards the corpus by an empirical beta prior (fitted by moments to
the host rates), and a host whose drawn rate is HOST_RATE or more loses all its documents.

Nulls and empty texts have no words and fail. A null host is a host of its own. Rows that repeat a
doc_id count and return as they are. Other columns of the input are ignored. Repeated 3-word windows
of a text are found by the 64-bit hashes of the windows, compared within that text only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.storage import materialize, small

MIN_WORDS = 50
HOST_RATE = 0.5
HOST_ROWS = 200_000  # hosts that may be broadcast
_WORD = r"[^\x20\x09-\x0D]+"


def document_figures(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    d = docs.select(F.col("doc_id").cast("long"), F.col(host).cast("string").alias("host"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    size = lambda c: F.size(c).cast("long")
    d = d.withColumns({"w": F.regexp_extract_all("t", F.lit(_WORD), 0), "lines": F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    d = d.select(
        "doc_id",
        "host",
        "w",
        size("w").alias("n_words"),
        F.char_length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (size("lines") - size(F.array_distinct("lines"))).alias("n_dup_lines"),
    )
    at = lambda i: F.get("w", i)
    windows = F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2))))
    d = d.withColumn("h", F.coalesce(windows, F.array().cast("array<long>"))).drop("w")
    d = d.withColumn("s", F.when(F.size("h") > F.size(F.array_distinct("h")), F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    same = lambda e, i: F.coalesce(F.get("s", i)["x"] == e["x"], F.lit(False))
    twice = F.filter("s", lambda e, i: same(e, i + 1) | ((i > 0) & same(e, F.greatest(i - 1, F.lit(0)))))
    d = d.withColumn("twice", F.transform(twice, lambda e: e["i"])).drop("s", "h")
    covered = F.size(F.array_distinct(F.flatten(F.transform("twice", lambda i: F.array(i, i + 1, i + 2)))))
    d = d.withColumn("n_repeat_words", F.when(F.col("twice").isNull(), 0).otherwise(covered).cast("long")).drop("twice")
    return d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def host_verdicts(figures: DataFrame, rate: float = HOST_RATE) -> DataFrame:
    """host, n_docs, n_failed, host_rate (drawn towards the corpus), host_failed."""
    hosts = figures.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    own = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(own).alias("m"), F.var_pop(own).alias("v")).first()
    m, v = prior.m or 0.0, prior.v or 0.0
    # as many pseudo-documents as the moments say; 2 where they say nothing
    k = m * (1 - m) / v - 1 if 0 < v < m * (1 - m) else 2.0
    drawn = (F.col("n_failed") + F.lit(m * k)) / (F.col("n_docs") + F.lit(k))
    return hosts.select("host", "n_docs", "n_failed", drawn.alias("host_rate"), (drawn >= rate).alias("host_failed"))


def quality_rules(docs: DataFrame, host: str = "source", rate: float = HOST_RATE) -> DataFrame:
    """A row for each document: its figures, base_failed, host_rate, host_failed, and kept."""
    figures = materialize(document_figures(docs, host), "quality-figures")
    hosts = small(materialize(host_verdicts(figures, rate), "quality-hosts"), HOST_ROWS).withColumnRenamed("host", "h")
    joined = figures.join(hosts, F.col("host").eqNullSafe(F.col("h")), "left")
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return joined.select(*cols, (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"), F.round("host_rate", 6).alias("host_rate"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), pos AS (
  SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3
), twice AS (
  SELECT rid, i FROM pos QUALIFY count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) > 1
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY rid
), f AS (
  SELECT doc_id, host, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered USING (rid)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f
), h AS (
  SELECT host, count(*) AS n, sum(CAST(base_failed AS BIGINT)) AS k FROM b GROUP BY host
), p AS (
  SELECT avg(k / n) AS m, var_pop(k / n) AS v FROM h
), q AS (
  SELECT m, CASE WHEN v > 0 AND v < m * (1 - m) THEN m * (1 - m) / v - 1 ELSE 2.0 END AS w FROM p
), r AS (
  SELECT host, (k + m * w) / (n + w) AS rate FROM h, q
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT rate >= 0.5 AS kept, round(rate, 6) AS host_rate
FROM b JOIN r ON b.host IS NOT DISTINCT FROM r.host
"""
