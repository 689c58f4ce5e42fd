"""Removal of long repeated byte strings by prefix-free parsing.

A byte is removed if it lies in a string of LENGTH bytes that also starts at another place of the
corpus, in the same text or another one. Matches never cross texts.

Parsing: a rolling hash of WINDOW bytes triggers where it is 0 mod EVERY; a phrase ends at each
trigger. The first trigger at or after a place is fixed by the bytes from there on, so equal strings
that start within REACH bytes before their first trigger have the same distance to it. All places of
one phrase are therefore treated at once: the suffixes of the corpus that begin at triggers are brought
into an order (by fingerprints of their first 208, then 336 bytes, then of the phrase before the
trigger and LENGTH bytes on) in which equal contexts stand side by side.
 - phrase and context both equal to a neighbour's: all places of the phrase repeat;
 - no equal context of the least length: none does;
 - the rest, and places without a trigger in reach: each place is tested by a fingerprint of its
   own LENGTH bytes. One phrase of each whole class beside such a place is tested with it.
This is the suffix order of dictionary and parse, kept as sorted runs that many tasks hold, rather
than as one suffix array in one memory. Within a task equal entries are combined before they are
sent, so a string that stands everywhere reaches another task once for each task, not for each copy.

Fingerprints have 64 bits (xxh3): a false match has odds of about 10^-11 for each GB held against a TB.
Nulls and empty texts: no bytes, no spans. Rows that repeat a doc_id and text are copies of each other.
Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.shingles import column_bytes
from webloom.storage import materialize

LENGTH = 400
WINDOW = 16
EVERY = 32
REACH = 192
NEAR = 64
HELD = 1_000_000  # phrases or places that a task combines at a time
SPANS = 1_000_000  # ranges that may be broadcast
_U = np.uint64
_BYTE = np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
SINGLE, MANY, KNOWN, LOOSE = 0, 1, 2, 3


def triggers(raw: bytes) -> np.ndarray:
    """Ascending places whose WINDOW bytes trigger."""
    h, step = _BYTE[np.frombuffer(raw, dtype=np.uint8)], 1
    while step < WINDOW and len(h) > step:
        h = h[:-step] * _U(0x9E3779B97F4A7C15) + (h[step:] ^ (h[step:] >> _U(29)))
        h ^= h >> _U(31)
        step *= 2
    return np.flatnonzero(h & _U(EVERY - 1) == 0) if step == WINDOW else np.empty(0, dtype=np.int64)


def phrases(raw: bytes):
    """Phrases (k2, k3, k1, lo, hi, p): places lo..hi with first trigger p; and loose ranges (lo, hi) of places without one in reach."""
    last = len(raw) - LENGTH
    own, loose = [], []
    if last < 0:
        return own, loose
    finger, prev = xxhash.xxh3_64_intdigest, -1
    view = memoryview(raw)
    for p in triggers(raw).tolist():
        lo = prev + 1
        prev = p
        if lo > last:
            break
        hi = p if p < last else last
        if p - lo > REACH:
            loose.append((lo, min(hi, p - REACH - 1)))
            lo = p - REACH
        if lo <= hi:
            k3 = finger(view[p : p + LENGTH - NEAR]) if p + LENGTH - NEAR <= len(raw) else 0
            own.append((finger(view[p : p + LENGTH - REACH]), k3, finger(view[lo : hi + LENGTH]), lo, hi, p))
    if prev < last:
        loose.append((prev + 1, last))
    return own, loose


def _signed(x) -> pa.Array:
    return pa.array(np.asarray(x, dtype=np.uint64).view(np.int64))


def _combined(key: np.ndarray) -> np.ndarray:
    """SINGLE, MANY (the first of several equal keys) or KNOWN (the others)."""
    _, first, of, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    kind = np.where(n[of] > 1, KNOWN, SINGLE)
    kind[first[n > 1]] = MANY
    return kind


def _parsed(batches):
    names = ["route", "k2", "k3", "k1", "rid", "lo", "hi", "p", "kind"]
    keys, places, free = array("Q"), array("q"), array("q")  # flat: three keys and four places of each phrase, three numbers of each loose range

    def send():
        a = np.array(keys, dtype=np.uint64).reshape(-1, 3)
        b = np.array(places, dtype=np.int64).reshape(-1, 4)
        del keys[:], places[:]
        kind = _combined(a[:, 2]) if len(a) else np.empty(0, dtype=np.int64)
        route = np.where(kind == KNOWN, b[:, 0].view(np.uint64) + b[:, 3].view(np.uint64) * _U(0x9E3779B97F4A7C15), a[:, 0])
        yield pa.RecordBatch.from_arrays([_signed(route), _signed(a[:, 0]), _signed(a[:, 1]), _signed(a[:, 2]), pa.array(b[:, 0]), *[pa.array(b[:, i].astype(np.int32)) for i in (1, 2, 3)], pa.array(kind.astype(np.int8))], names=names)
        if free:
            c = np.array(free, dtype=np.int64).reshape(-1, 3)
            del free[:]
            zero = pa.array(np.zeros(len(c), dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c[:, 0] + c[:, 1]), zero, zero, zero, pa.array(c[:, 0]), *[pa.array(c[:, i].astype(np.int32)) for i in (1, 2, 2)], pa.array(np.full(len(c), LOOSE, dtype=np.int8))], names=names)

    for b in batches:
        for rid, raw in zip(b.column(0).to_pylist(), column_bytes(b.column(1)), strict=True):
            own, loose = phrases(raw)
            for k2, k3, k1, lo, hi, p in own:
                keys.extend((k2, k3, k1))
                places.extend((rid, lo, hi, p))
            for x, y in loose:
                free.extend((rid, x, y))
            if len(keys) + len(free) > 3 * HELD:
                yield from send()
    if keys or free:
        yield from send()


def _starts(key: np.ndarray, within: np.ndarray | None = None) -> np.ndarray:
    """Group number of each row of a sorted key."""
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    if within is not None:
        new[1:] |= within[1:] != within[:-1]
    return np.cumsum(new) - 1


def _groups(batches, columns: int):
    """Tables of whole groups of the first column, of rows sorted by it; never more rows than a batch and one group."""
    held: list[list[np.ndarray]] = []  # batches of the group that is not ended yet
    for b in batches:
        t = [b.column(i).to_numpy() for i in range(columns)]
        if not len(t[0]):
            continue
        if held and t[0][0] == held[0][0][-1] == t[0][-1]:
            held.append(t)
            continue
        if held:
            t = [np.concatenate([*(h[i] for h in held), x]) for i, x in enumerate(t)]
        cut = int(np.searchsorted(t[0], t[0][-1]))
        held = [[x[cut:] for x in t]]
        if cut:
            yield [x[:cut] for x in t]
    if held:
        yield [np.concatenate([h[i] for h in held]) for i in range(columns)]


def _classified(batches):
    """(rid, lo, hi, test): places that repeat, and places to be tested one by one."""

    def out(rid, lo, hi, test):
        return pa.RecordBatch.from_arrays([pa.array(rid), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(np.full(len(rid), test))], names=["rid", "lo", "hi", "test"])

    for k2, k3, k1, rid, lo, hi, p, kind in _groups(batches, 8):
        known, loose = kind == KNOWN, kind == LOOSE
        yield out(rid[known], lo[known], hi[known], False)
        yield out(rid[loose], lo[loose], hi[loose], True)
        rest = ~known & ~loose
        k2, k3, k1, rid, lo, hi, p, kind = (x[rest] for x in (k2, k3, k1, rid, lo, hi, p, kind))
        if not len(k2):
            continue
        g2 = _starts(k2)
        g3 = _starts(k3, g2)
        g1 = _starts(k1, g3)
        n2, n3, n1 = (np.bincount(g)[g] for g in (g2, g3, g1))
        many = np.bincount(g1, weights=kind == MANY)[g1] > 0
        full = (n1 > 1) | many
        far = p - lo > NEAR
        close = (k3 != 0) & (n3 > 1)
        unsure = ~full & (close | (far & (n2 > 1)))
        beside = (np.bincount(g3, weights=unsure)[g3] > 0) | (far & (np.bincount(g2, weights=unsure & far)[g2] > 0))
        first = np.ones(len(g1), dtype=bool)
        first[1:] = g1[1:] != g1[:-1]
        yield out(rid[full], lo[full], hi[full], False)
        a = np.where(far & (n2 > 1), lo, np.maximum(lo, p - NEAR))
        b = np.where(close, hi, np.minimum(hi, p - NEAR - 1))
        ok = unsure & (a <= b)
        yield out(rid[ok], a[ok], b[ok], True)
        stand = full & first & beside
        yield out(rid[stand], lo[stand], hi[stand], True)


def _places(batches):
    """(route, key, rid, i, kind) of each place to be tested."""
    keys, rids, at = array("Q"), array("q"), array("q")

    def send():
        key, rid, i = np.array(keys, dtype=np.uint64), np.array(rids, dtype=np.int64), np.array(at, dtype=np.int64)
        del keys[:], rids[:], at[:]
        kind = _combined(key)
        route = np.where(kind == KNOWN, rid.view(np.uint64) + i.view(np.uint64) * _U(0x9E3779B97F4A7C15), key)
        return pa.RecordBatch.from_arrays([_signed(route), _signed(key), pa.array(rid), pa.array(i.astype(np.int32)), pa.array(kind.astype(np.int8))], names=["route", "key", "rid", "i", "kind"])

    finger = xxhash.xxh3_64_intdigest
    for b in batches:
        for rid, raw, spans in zip(b.column(0).to_pylist(), column_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
            view = memoryview(raw)
            for s in spans:
                r = range(s["lo"], s["hi"] + 1)
                keys.extend([finger(view[i : i + LENGTH]) for i in r])
                at.extend(r)
                rids.extend([rid] * len(r))
            if len(keys) > HELD:
                yield send()
    if keys:
        yield send()


def _twice(batches):
    """(rid, lo, hi): runs of places whose key comes twice."""
    for key, rid, i, kind in _groups(batches, 4):
        g = _starts(key)
        own = kind != KNOWN
        n = np.bincount(g, weights=own)[g]
        ok = (kind == KNOWN) | (kind == MANY) | (n > 1) | (np.bincount(g, weights=kind == MANY)[g] > 0)
        yield pa.RecordBatch.from_arrays([pa.array(rid[ok]), pa.array(i[ok]), pa.array(i[ok])], names=["rid", "lo", "hi"])


def cut(raw: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, str]:
    """Bytes removed, maximal removed runs, and the SHA-256 of what is left, for spans of places that repeat."""
    runs: list[list[int]] = []
    for lo, hi in sorted(spans):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi + LENGTH)
        else:
            runs.append([lo, hi + LENGTH])
    left, at = hashlib.sha256(), 0
    for a, b in runs:
        left.update(raw[at:a])
        at = b
    left.update(raw[at:])
    return sum(b - a for a, b in runs), len(runs), left.hexdigest()


def _result(batches):
    for b in batches:
        rows: list[list] = [[], [], [], []]
        for raw, spans in zip(column_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
            for x, v in zip(rows, (len(raw), *cut(raw, [(s["lo"], s["hi"]) for s in spans or []])), strict=True):
                x.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _by_document(rows: DataFrame, name: str) -> DataFrame:
    """rid, spans: its ranges of places with those that touch merged. Broadcast if all ranges together are SPANS at most."""
    own = rows.groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("s"))

    def step(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        longer = F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], x["hi"]).alias("hi"))
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer))
        return F.when((F.size(acc) > 0) & (x["lo"] <= last["hi"] + 1), joined).otherwise(F.concat(acc, F.array(x)))

    none = F.array().cast("array<struct<lo:int,hi:int>>")
    own = materialize(own.select("rid", F.aggregate("s", none, step).alias("spans")), name)
    total = own.agg(F.sum(F.size("spans") + 1)).first()[0] or 0
    return F.broadcast(own) if total <= SPANS else own


def repeated(docs: DataFrame) -> DataFrame:
    """docs(rid, text). Returns rid, spans: array of (lo, hi), the places where repeated strings of LENGTH bytes start."""
    parsed = docs.mapInArrow(_parsed, "route long, k2 long, k3 long, k1 long, rid long, lo int, hi int, p int, kind byte")
    parsed = parsed.repartition("route").drop("route").sortWithinPartitions("k2", "k3", "k1")
    found = materialize(parsed.mapInArrow(_classified, "rid long, lo int, hi int, test boolean"), "repeat-classes")
    tests = docs.join(_by_document(found.where("test"), "repeat-tests"), "rid").select("rid", "text", "spans")
    places = tests.mapInArrow(_places, "route long, key long, rid long, i int, kind byte").repartition("route").drop("route").sortWithinPartitions("key")
    more = materialize(places.mapInArrow(_twice, "rid long, lo int, hi int"), "repeat-places")
    return _by_document(found.where("not test").select("rid", "lo", "hi").union(more), "repeat-spans")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("rid", F.xxhash64("text", "doc_id"))
    spans = repeated(docs.select("rid", "text"))
    return docs.join(spans, "rid", "left").select("doc_id", "text", "spans").mapInArrow(_result, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
