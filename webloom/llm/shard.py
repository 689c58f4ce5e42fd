"""Shards of near equal bytes by histogram sort, in DataFrame operations only.

Key: the upper 40 bits are a hash of the text and the lower 24 a hash of doc_id. So equal texts lie
side by side (and in one shard, unless their group is larger than the tolerance allows), and a group
of any size can still be cut. Rounds of probes count the exact bytes below candidate boundaries
(one aggregation a round over (key, size) rows) until every boundary is within the tolerance or lies
between neighbouring keys. Then rows are exchanged once, to pieces of known size and place.

Nulls: a null text has no bytes (size 1, crc32 0); a null doc_id hashes as such. Rows that repeat a
doc_id and text have one key and share a piece. An empty table gives an empty result. Other columns
of the input are ignored here.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.storage import materialize

SHARDS = 8
TOLERANCE = 0.002  # of a shard's bytes, for each boundary
PROBES = 16  # between the bounds of a boundary, in a round
PIECE_ROWS = 20_000  # of a piece of a shard, about
PIECES = 64  # of a shard at most; larger pieces are sorted on disk
_GROUP = 1 << 24
_END = 1 << 63


def bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most key: a binary search, in as many steps as their number has bits."""
    if not bounds:
        return F.lit(0)
    last = len(bounds) - 1
    table = F.array(*[F.lit(b) for b in bounds])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])

    def step(at: Column, d: Column) -> Column:
        return at + F.when((at + d <= last + 1) & (F.get(table, F.least(at + d - 1, F.lit(last))) <= key), d).otherwise(0)

    return F.aggregate(steps, F.lit(0), step)


def _below(keys: DataFrame, probes: list[int], known: dict[int, int]) -> None:
    """Adds to known the exact bytes of the keys below each probe, and below the ends of the keys found between probes."""
    rows = keys.groupBy(bucket(F.col("key"), probes).alias("b")).agg(F.sum("size").alias("s"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()  # len(probes) + 1 rows
    got = {r.b: r for r in rows}
    total = 0
    for i, p in enumerate([-_END, *probes]):
        known[p] = total
        if i in got:
            known[got[i].lo] = total
            total += got[i].s
            known[got[i].hi + 1] = total


def _spread(lo: int, hi: int, n: int) -> list[int]:
    """n inner points of (lo, hi), on group borders while these are far enough apart."""
    step = max(1, (hi - lo) // (n + 1))
    points = range(lo + step, hi, step)
    if step >= 4 * _GROUP:
        return sorted({p // _GROUP * _GROUP for p in points} - {lo, hi})[: n + 1]
    borders = range((lo // _GROUP + 1) * _GROUP, hi, _GROUP)
    if 0 < len(borders) <= n:
        return list(borders)
    return list(points)[: n + 1]


def splitters(keys: DataFrame, parts: int, tolerance: float) -> list[int]:
    """parts - 1 ascending boundaries, off by tolerance (a share of all bytes) at most: keys below the first make the first part."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    targets = [total * i / parts for i in range(1, parts)]
    known = {-_END: 0, _END - 1: total}
    while True:
        points = sorted(known)
        values = [known[p] for p in points]
        probes: set[int] = set()
        chosen = []
        for t in targets:
            i = min(max(1, bisect_right(values, t)), len(points) - 1)
            lo, hi = points[i - 1], points[i]
            near = min((lo, hi), key=lambda p: abs(known[p] - t))
            chosen.append(near)
            if abs(known[near] - t) > tolerance * total and hi - lo > 1 and known[hi] > known[lo]:
                probes.update(_spread(lo, hi, PROBES))
        if not probes:
            return [max(x, -_END + 1) for x in chosen]
        _below(keys, sorted(probes), known)


def shards(docs: DataFrame, n: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """A row for each document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    raw = docs.select(F.col("doc_id").cast("long"), text.alias("t"))
    key = F.xxhash64("t").bitwiseAND(F.lit(-_GROUP)).bitwiseOR(F.xxhash64("doc_id", F.lit(1)).bitwiseAND(F.lit(_GROUP - 1)))
    rows = materialize(raw.select("doc_id", (F.octet_length("t") + 1).cast("long").alias("size"), F.crc32(F.col("t").cast("binary")).alias("text_crc32"), key.alias("key")), "shard-keys")
    count = rows.count()
    pieces = min(PIECES, count // (n * PIECE_ROWS) + 1)  # of each shard, so that no task sorts a whole one
    bounds = splitters(rows.select("key", "size"), n * pieces, tolerance / n)
    rows = rows.withColumn("piece", bucket(F.col("key"), bounds)).withColumn("shard", F.expr(f"cast(piece div {pieces} as int)"))
    before = rows.groupBy("shard", "piece").count()
    w = Window.partitionBy("shard").orderBy("piece")
    before = materialize(before.select("shard", "piece", (F.sum("count").over(w) - F.col("count")).alias("start")), "shard-pieces")  # n * PIECES rows at most
    order = Window.partitionBy("shard", "piece").orderBy("key", F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    placed = rows.withColumn("k", F.row_number().over(order) - 1).join(before, ["shard", "piece"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("k")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
