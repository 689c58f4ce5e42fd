"""Benchmark decontamination, in DataFrame and SQL operations only.

A document leaks an item if one of its windows, as long in words as the item, has a weighted-shingle
similarity of THRESHOLD or more with it: shingles of 5 words, weighted by how often they occur,
shared weight over joint weight. Words are runs of letters and digits, lower-cased.

1. Every position of every text is looked up in the items' shingles. A document goes on, for an item,
   if it has shingles for THRESHOLD of the item's weight; without them no window can reach it.
2. A window is laid at every start from which it holds enough positions with shingles of the item to
   reach THRESHOLD (8/9 of its own), and gets a 64-bit SimHash fingerprint.
3. Fingerprints within RADIUS bits of an item's of the same length are found by 8 blocks of 8 bits:
   two such fingerprints differ by RADIUS / 8 bits or less in one block at least, and each item
   is entered under all block values that near. At similarity 0.8 a distance over RADIUS has odds of
   about one in a million.
4. Candidates are verified by their exact weighted similarity.

An item or text with fewer than 5 words is one shingle, its whole sequence. Nulls, empty texts and
texts without words leak nothing and are never leaked. Rows are told apart by a hash of doc_id and
text, so those that repeat a doc_id are looked at one by one; they give one answer for each item, and
so do all rows without a doc_id. Of those, each leaking row is dropped by keep_unleaked().
Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.storage import materialize, small

K = 5
PERCENT = 80  # the least similarity
RADIUS = 23
ENTRY_ROWS = 1_000_000  # of item shingles that may be broadcast
PAIR_ROWS = 500_000  # of (document, item) candidates that may be broadcast


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)


def _hashes(w: str, k: int) -> Column:
    """Hashes of the k-word shingles of the word array w."""
    one = lambda i: F.xxhash64(*[F.get(F.col(w), i + j) for j in range(k)])
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), one)).otherwise(F.array().cast("array<long>"))


def simhash(h: str) -> Column:
    """SQL for the SimHash of an array of 64-bit hashes, each as often as it occurs: 32 sums of two 32-bit fields hold the votes of 64 bits."""
    sums = f"aggregate({h}, transform(sequence(0, 31), j -> 0L), (s, x) -> transform(s, (v, j) -> v + (shiftrightunsigned(x, j) & 4294967297L)))"
    low, high = "(s[j] & 4294967295L)", "shiftrightunsigned(s[j], 32)"
    bits = f"aggregate(sequence(0, 31), 0L, (f, j) -> f | if(2 * {low} > size({h}), shiftleft(1L, j), 0L) | if(2 * {high} > size({h}), shiftleft(1L, j + 32), 0L))"
    return F.expr(f"transform(array({sums}), s -> {bits})[0]")


def _near(radius: int) -> list[int]:
    """All 8-bit masks with so many bits set at most."""
    return [m for m in range(256) if m.bit_count() <= radius]


def items(benchmark: DataFrame) -> DataFrame:
    """item_id, m (words), k (words of a shingle), h (shingle hashes), f (fingerprint)."""
    b = benchmark.select(F.col("item_id").cast("long"), _words(F.col("text")).alias("w")).where("size(w) > 0")
    cases = F.coalesce(*[F.when(F.least(F.size("w"), F.lit(K)) == k, _hashes("w", k)) for k in range(1, K + 1)])
    b = b.select("item_id", F.size("w").alias("m"), F.least(F.size("w"), F.lit(K)).alias("k"), cases.alias("h"))
    return b.withColumn("f", simhash("h"))


def _starts(k: int) -> Column:
    """The starts in a text of n words from which a window of m has enough of the sorted positions at, each once; 0 for a text that is no longer than the window."""
    size = f"(m - {k} + 1)"
    need = f"(({2 * PERCENT} * {size} + {100 + PERCENT - 1}) div {100 + PERCENT})"  # of the window's shingles
    first = f"greatest(0, coalesce(get(at, i - 1), -1) + 1, at[cast(i + {need} - 1 as int)] - {size} + 1)"  # at[i] is the first position in the window
    last = "least(at[i], n - m)"
    some = f"transform(sequence(0, cast(size(at) - {need} as int)), i -> if({first} <= {last}, sequence({first}, {last}), cast(array() as array<int>)))"
    return F.expr(f"case when n <= m then array(0) when size(at) < {need} then cast(array() as array<int>) else flatten({some}) end")


def _row() -> Column:
    """What a row goes by."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def leaking_rows(docs: DataFrame, benchmark: DataFrame, radius: int) -> DataFrame:
    """A row for each text and item that it leaks: row (its hash), doc_id, item_id, similarity, window_start, n_windows."""
    item = materialize(items(benchmark), "items")
    ks = sorted(r.k for r in item.select("k").distinct().collect())  # 5 values at most
    entries = item.select("k", "item_id", "m", F.size("h").alias("weight"), F.explode("h").alias("hash")).groupBy("k", "item_id", "m", "weight", "hash").agg(F.count("*").alias("times"))
    entries = small(materialize(entries, "item-shingles"), ENTRY_ROWS)
    docs = docs.select(_row().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    words = docs.select("row", "doc_id", _words(F.col("text")).alias("w"))
    seeds = None
    for k in ks:
        own = words.select("row", "doc_id", F.posexplode(_hashes("w", k)).alias("p", "hash")).join(entries.where(F.col("k") == k), "hash").select("row", "doc_id", "item_id", "m", "k", "weight", "hash", "times", "p")
        seeds = own if seeds is None else seeds.union(own)
    if seeds is None:
        return docs.select("row", "doc_id", F.lit(None).cast("long").alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).alias("window_start"), F.lit(0).cast("long").alias("n_windows")).where("false")
    pairs = seeds.groupBy("row", "doc_id", "item_id", "m", "k", "weight").agg(F.collect_set(F.struct("hash", "times")).alias("shared"), F.collect_set("p").alias("at"))
    pairs = pairs.where(f"100 * aggregate(shared, 0L, (s, x) -> s + x.times) >= {PERCENT} * weight")
    pairs = materialize(pairs.select("row", "item_id", "m", "k", F.array_sort("at").alias("at")), "leak-pairs")

    own = docs.join(small(pairs.select("row").distinct(), PAIR_ROWS), "row").select("row", "doc_id", _words(F.col("text")).alias("w"))
    windows = None
    for k in ks:
        h = own.select("row", "doc_id", F.size("w").alias("n"), _hashes("w", k).alias("d")).join(small(pairs.where(F.col("k") == k), PAIR_ROWS, 1 + F.size("at")), "row")
        h = h.withColumn("start", _starts(k))
        window = F.transform("start", lambda s: F.struct(s.alias("start"), F.slice("d", s + 1, F.greatest(F.lit(0), F.col("m") - k + 1)).alias("h")))  # noqa: B023
        h = h.select("row", "doc_id", "m", "k", F.inline(window))
        windows = h if windows is None else windows.union(h)
    windows = windows.where("size(h) > 0").dropDuplicates(["row", "m", "start", "h"]).withColumn("f", simhash("h"))

    block = lambda f: [F.shiftrightunsigned(f, 8 * j).bitwiseAND(F.lit(255)) for j in range(8)]
    probes = F.array(*[F.lit(x) for x in _near(radius // 8)])
    index = item.select(F.col("m"), "item_id", F.col("h").alias("ih"), F.col("f").alias("if"), F.posexplode(F.array(*block("f"))).alias("j", "value"))
    index = index.select("m", "item_id", "ih", "if", "j", F.explode(F.transform(probes, lambda x: x.bitwiseXOR(F.col("value")))).alias("value"))
    found = windows.select("row", "doc_id", "m", "start", "h", "f", F.posexplode(F.array(*block("f"))).alias("j", "value")).join(index, ["m", "j", "value"])
    found = found.where(F.bit_count(F.col("f").bitwiseXOR(F.col("if"))) <= radius).dropDuplicates(["row", "item_id", "start", "h"])
    shared = F.expr("aggregate(array_intersect(h, ih), 0, (s, x) -> s + least(size(filter(h, y -> y = x)), size(filter(ih, y -> y = x))))")
    found = found.select("row", "doc_id", "item_id", "start", shared.alias("both"), (F.size("h") + F.size("ih")).alias("sum"))
    found = found.where(f"100 * both >= {PERCENT} * (sum - both)").withColumn("similarity", F.col("both") / (F.col("sum") - F.col("both")))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s")))
    found = found.groupBy("row", "doc_id", "item_id").agg(best.alias("b"), F.count("*").alias("n_windows"))
    return found.select("row", "doc_id", "item_id", F.col("b.similarity").alias("similarity"), (-F.col("b.s")).alias("window_start"), "n_windows")


def leaks(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS) -> DataFrame:
    """A row for each leaked pair: doc_id, item_id, similarity (of the best window), window_start (its first word), n_windows (of those that reach it)."""
    rows = leaking_rows(docs, benchmark, radius).groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("window_start")).alias("s"))).alias("b"), F.sum("n_windows").alias("n_windows"))
    return rows.select("doc_id", "item_id", F.col("b.similarity").alias("similarity"), (-F.col("b.s")).alias("window_start"), "n_windows")


def keep_unleaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that leak an item; all columns stay."""
    bad = materialize(leaking_rows(docs, benchmark, RADIUS).select(F.col("row").alias("_row")).distinct(), "leaking")
    return docs.join(small(bad, PAIR_ROWS), _row() == F.col("_row"), "left_anti").select(*docs.columns)


# windows are compared shingle by shingle for every document and item that share one
ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)
), b AS (
  SELECT item_id, w, len(w) AS m, least(len(w), 5) AS k FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark) WHERE len(w) > 0
), s AS (
  SELECT item_id, array_to_string(w[p : p + k - 1], ' ') AS g, count(*) AS times FROM (SELECT *, unnest(range(1, m - k + 2)) AS p FROM b) GROUP BY ALL
), t AS (
  SELECT r, k, p - 1 AS p, array_to_string(w[p : p + k - 1], ' ') AS g
  FROM (SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM b))
), hit AS (
  SELECT t.r, b.item_id, b.m, b.k, t.p, t.g, s.times FROM t JOIN s ON t.g = s.g JOIN b ON b.item_id = s.item_id AND b.k = t.k
), win AS (
  SELECT DISTINCT hit.r, hit.item_id, hit.m, hit.k, len(d.w) AS n,
         unnest(CASE WHEN len(d.w) <= hit.m THEN [0] ELSE range(greatest(0, hit.p - (hit.m - hit.k)), least(hit.p, len(d.w) - hit.m) + 1) END) AS start
  FROM hit JOIN d ON d.r = hit.r
), both_ AS (
  SELECT r, item_id, m, k, n, start, sum(least(c, times)) AS both_
  FROM (SELECT win.r, win.item_id, win.m, win.k, win.n, win.start, hit.g, hit.times, count(*) AS c
        FROM win JOIN hit ON hit.r = win.r AND hit.item_id = win.item_id AND hit.p BETWEEN win.start AND win.start + win.m - win.k
        GROUP BY ALL)
  GROUP BY ALL
), sim AS (
  SELECT r, item_id, start, both_, (least(n, m) - k + 1) + (m - k + 1) - both_ AS every FROM both_
)
SELECT doc_id, item_id, max(CAST(both_ AS DOUBLE) / CAST(every AS DOUBLE)) AS similarity,
       CAST(arg_max(start, CAST(both_ AS DOUBLE) / CAST(every AS DOUBLE) - start * 1e-12) AS INTEGER) AS window_start, count(*) AS n_windows
FROM sim JOIN d ON d.r = sim.r WHERE 100 * both_ >= 80 * every GROUP BY doc_id, item_id
"""
