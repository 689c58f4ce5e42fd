"""N-gram Jaccard self-join by T-occurrence search, and the groups that its links form.

Two texts link when the Jaccard similarity of their sets of 5-word shingles is THRESHOLD or more.

1. Every text becomes a set; equal sets are one class, so copies never meet as pairs.
2. By T-occurrence, classes of n and m shingles link only if they share ceil(4/9 (n + m)) of them, so
   a link shows among the shortest lists: it shares a shingle of both prefixes (n - ceil(0.8 n) + 1
   shingles, frequent ones last). The prefixes make the inverted lists, one shuffle for the corpus.
3. Linked classes share even least(n, m) shingles of both prefixes, see least_shared(). A class goes on
   if for some number k at least k of its lists have a partner of a size for which k would do; most
   texts that share a few shingles by chance end here.
4. Rounds of stars: each class of a list is held against HUBS classes of that list, drawn by a hash
   that is the same in every list. Links so verified join classes into groups; lists within one group
   are done. Rounds go on, with other draws, as long as they join groups and the lists left hold
   more than PAIRS_A_ROW pairs of different groups for each row of all lists.
5. Then every pair of classes from different groups is held against each other that shares a shingle
   of its own prefixes: as a pair shares least_shared(n, m) listed shingles, so many of them stand from
   the first shared one on, in any order. In these lists the order is by their length, shortest first.
   A pair is made at the first shared shingle; a row that sees a shared one among the EARLIER before it
   makes none. So no link between groups is missed, and few pairs are made twice or inside a group.
6. Pairs go on to verification if a bitmap of BITS parities allows a link: bits in which two sets'
   parities differ are at most the shingles that only one of them has, so no link is lost. Within
   the lists the same is tried first with the bitmap folded to FOLDED bits, which stays one of parities.
7. A pair is verified on whole texts: one class is the query, the others (in chunks) are an index
   that DivideSkip searches: short lists are merged, long lists probed by binary search.

The order of shingles affects speed alone; any order gives the same result.
A class goes by its hash, and its text is fetched by one of its rows: that of the least doc_id, and
of those the least hash of its text. So rows with a null or repeated doc_id are linked like others,
each by its own text. Nulls, empty texts and texts without words: an empty set, linked with nothing.
A null doc_id is never a component_id unless its whole group has none. Other columns of the input
are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.components import components
from webloom.llm.memory import releasing, small_batches
from webloom.llm.shingles import column_bytes, shingle_sets
from webloom.storage import discard, materialize, small

NUM, DEN = 80, 100  # the least similarity
HEAVY_ROWS = 1 << 20  # most frequent shingles that workers are told of, to put them last
CHUNK = 128  # classes in one index
BROADCAST_ROWS = 500_000  # of (id, id, id) rows
BITS = 2048  # of a set's bitmap
FOLDED = 256
EARLIER = 8  # shingles of a class that a row of its lists carries, to see whether a pair was made before
HUBS = 4  # classes that a list is held against in a round
PAIRS_A_ROW = 64  # pairs of different groups for each row of the lists, from which on another round is worth its cost
_BITMAP = [f"b{i}" for i in range(FOLDED // 64)]


def required(n: int, m: int) -> int:
    """The least overlap of linked sets of n and m."""
    return -(-NUM * (n + m) // (NUM + DEN))


def least_shared(n, m):
    """How many shingles of both prefixes linked sets of n and m share at least. Up to where the first of the two prefixes ends, the other set's shingles stand in its prefix too, and of that prefix at most n - required(n, m) shingles are missed (m - required(n, m) if it is the other's)."""
    most = np.maximum(n, m)
    return -(-NUM * (n + m) // (NUM + DEN)) - -(-NUM * most // DEN) + 1


def class_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s)) - 2**63


def bitmap(s: np.ndarray) -> np.ndarray:
    """For each of BITS buckets of shingles the parity of their number, packed into 64-bit numbers."""
    parity = np.bincount((s >> np.uint64(23) & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def _signatures(batches):
    """Rows (doc_id, key, n, class, bitmap) of each document, and rows (shingle, count) of shingles that come again and again."""
    names = ["doc_id", "key", "n", "class", "token", "count", "bits"]
    kind = pa.list_(pa.int64())
    seen: list[np.ndarray] = []

    def frequent():
        token, count = np.unique(np.concatenate(seen), return_counts=True)
        seen.clear()
        token, count = token[count > 2], count[count > 2]
        none = pa.nulls(len(token), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(token.view(np.int64)), pa.array(count), pa.nulls(len(token), kind)], names=names)

    held = 0
    for b in batches:
        n, c, bits = [], [], []
        for s in shingle_sets(column_bytes(b.column(1))):
            n.append(len(s))
            c.append(class_of(s) if len(s) else None)
            bits.append(bitmap(s))
            seen.append(s)
            held += len(s)
            if held > 2_000_000:
                yield frequent()
                held = 0
        none = pa.nulls(len(n), pa.int64())
        at = np.arange(0, len(n) * BITS // 64 + 1, BITS // 64, dtype=np.int32)
        bits = pa.ListArray.from_arrays(at, np.concatenate(bits)) if bits else pa.nulls(0, kind)
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(2), pa.array(n, pa.int64()), pa.array(c, pa.int64()), none, none, bits], names=names)
    if seen:
        yield frequent()


def _prefixes(heavy: np.ndarray):
    def run(batches):
        done: set[int] = set()
        for b in batches:
            tokens, classes, sizes = [], [], []
            for s in shingle_sets(column_bytes(b.column(0))):
                n = len(s)
                if not n or (c := class_of(s)) in done:
                    continue
                done.add(c)
                if len(heavy):
                    late = heavy[np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)] == s
                    s = np.concatenate([s[~late], s[late]])
                p = n - -(-NUM * n // DEN) + 1
                tokens.append(s[:p])
                classes.append(np.full(p, c, dtype=np.int64))
                sizes.append(np.full(p, n, dtype=np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(classes)), pa.array(np.concatenate(sizes))], names=["token", "class", "n"])

    return run


def _lists(batches):
    """Of rows (token, class, n) sorted by the first two, those of tokens with several classes, each class once. need: least_shared() at best, with any size between the list's least and largest (1 for a list that goes over several batches)."""
    sent = last = held = None  # the token of which rows went on, the last row's token and class, the one row of a token not sent yet
    for b in batches:
        t, c, n = (b.column(i).to_numpy() for i in range(3))
        if not len(t):
            continue
        new = np.ones(len(t), dtype=bool)
        new[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
        new[0] = (t[0], c[0]) != last
        last = (t[-1], c[-1])
        t, c, n = t[new], c[new], n[new]
        if held is not None:
            t, c, n = (np.concatenate([x, y]) for x, y in zip(held, (t, c, n), strict=True))
        if not len(t):
            continue
        at = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        size = np.diff(np.append(at, len(t)))
        several = size > 1
        several[0] |= t[0] == sent
        keep = np.repeat(several, size)
        low, high = (np.repeat(f.reduceat(n, at).astype(np.int64), size) for f in (np.minimum, np.maximum))
        own = n.astype(np.int64)
        low, high = np.maximum(low, -(-NUM * own // DEN)), np.minimum(high, DEN * own // NUM)
        need = np.maximum(1, np.minimum(least_shared(own, np.minimum(low, own)), least_shared(own, np.maximum(high, own))) - 1)  # between the ends it falls short by 1 at most, as it is rounded
        need[: size[0]] = need[len(t) - size[-1] :] = 1
        held = None if several[-1] else (t[-1:], c[-1:], n[-1:])
        sent = t[-1] if several[-1] else None
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(t[keep]), pa.array(c[keep]), pa.array(n[keep]), pa.array(need[keep].astype(np.int32))], names=["token", "class", "n", "need"])


class DivideSkip:
    """An inverted index of a few sets: which of them share t elements or more with a query set."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        every = np.concatenate(sets) if sets else np.empty(0, dtype=np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(every, kind="stable")
        self.owner = owner[order]
        self.tokens, self.first = np.unique(every[order], return_index=True)
        self.end = np.append(self.first[1:], len(every))

    def search(self, query: np.ndarray, needed: np.ndarray) -> np.ndarray:
        """Whether each set shares needed[i] elements (1 at least) with the query."""
        at = np.searchsorted(self.tokens, query)
        at = at[(at < len(self.tokens)) & (self.tokens[np.minimum(at, len(self.tokens) - 1)] == query)] if len(self.tokens) else at[:0]
        at = at[np.argsort(self.end[at] - self.first[at], kind="stable")]
        least = int(needed.min()) if len(needed) else 1
        long = min(least - 1, int(least / (0.0085 * np.log2(max(2, len(at))) + 1)))
        short, rest = at[: max(0, len(at) - long)], at[max(0, len(at) - long) :]
        count = np.zeros(len(self.sizes), dtype=np.int64)
        lists = [self.owner[self.first[i] : self.end[i]] for i in short]
        if len(lists) < 16:
            for i in heapq.merge(*lists):
                count[i] += 1
        else:  # the same merge, by counting
            count += np.bincount(np.concatenate(lists), minlength=len(count))
        found = np.flatnonzero(count >= np.maximum(1, needed - len(rest)))
        for i in rest:
            ids = self.owner[self.first[i] : self.end[i]]
            if len(found) and len(ids):
                hit = np.minimum(np.searchsorted(ids, found), len(ids) - 1)
                count[found[ids[hit] == found]] += 1
        ok = np.zeros(len(count), dtype=bool)
        ok[found] = count[found] >= needed[found]
        return ok


def _verify(rows: pa.Table) -> pa.Table:
    """Rows (b, part, doc, text, query): the query's links with the other rows of its part."""
    query = next(shingle_sets(column_bytes(rows.filter(rows["query"])["text"].slice(0, 1).combine_chunks())))
    others = rows.filter(pa.compute.invert(rows["query"]))
    sets = list(shingle_sets(column_bytes(others["text"].combine_chunks())))
    ok = DivideSkip(sets).search(query, np.array([required(len(query), len(s)) for s in sets], dtype=np.int64))
    own = others["doc"].to_numpy()[ok]
    return pa.table({"u": pa.array(own, pa.int64()), "v": pa.array(np.full(len(own), rows["b"][0].as_py()), pa.int64())})


def _key(text: str) -> Column:
    """The hash that a row's text goes by."""
    return F.xxhash64(F.col(text).cast("string"))


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, name: str) -> DataFrame:
    """pairs(a, b) of classes; docs(doc_id, text). Returns the links among them as (u, v)."""
    pairs = materialize(pairs.distinct(), f"{name}-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    wanted = materialize(wanted.join(classes.select(F.col("class").alias("doc"), F.col("row.doc_id").alias("id"), F.col("row.key").alias("key")), "doc"), f"{name}-ids")
    texts = docs.join(small(wanted, BROADCAST_ROWS), F.col("doc_id").eqNullSafe(F.col("id")) & (_key("text") == F.col("key"))).select("doc", "text").dropDuplicates(["doc"])
    texts = materialize(texts, f"{name}-texts")
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / CHUNK).alias("parts"))
    dealt = pairs.join(parts, "b").withColumn("part", F.pmod(F.xxhash64("a"), "parts"))
    one = dealt.join(texts.withColumnRenamed("doc", "a"), "a").select("b", "part", F.col("a").alias("doc"), "text", F.lit(False).alias("query"))
    all_parts = parts.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    two = all_parts.join(texts.withColumnRenamed("doc", "b"), "b").select("b", "part", F.col("b").alias("doc"), "text", F.lit(True).alias("query"))
    links = one.unionByName(two).groupBy("b", "part").applyInArrow(_verify, "u long, v long")
    links = materialize(links, f"{name}-links")
    discard(pairs, wanted, texts)
    return links


def _entries(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents (doc_id, key, n, class), the classes with the row that stands for each and their bitmaps, and the prefix lists (token, class, n). docs: doc_id, text."""
    signed = docs.select("doc_id", "text", _key("text").alias("key")).mapInArrow(releasing(_signatures), "doc_id long, key long, n long, class long, token long, count long, bits array<long>")
    first = materialize(signed, "jaccard-sets")
    sets = first.where("token is null").select("doc_id", "key", "n", "class")
    heavy = first.where("token is not null").groupBy("token").agg(F.sum("count").alias("count")).where("count > 24").orderBy(F.desc("count"), "token").limit(HEAVY_ROWS)
    heavy = np.sort(np.array([r.token for r in heavy.select("token").toLocalIterator()], dtype=np.int64).view(np.uint64))
    row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))  # null ids last
    classes = first.where("class is not null").groupBy("class").agg(row.alias("row"), F.first("bits").alias("bits"))
    folded = [F.expr(" ^ ".join(f"bits[{j}]" for j in range(i, BITS // 64, len(_BITMAP)))).alias(b) for i, b in enumerate(_BITMAP)]
    classes = materialize(classes.select("*", *folded), "jaccard-classes")

    entries = docs.select("text").mapInArrow(releasing(_prefixes(heavy)), "token long, class long, n int")
    entries = entries.repartition("token").sortWithinPartitions("token", "class")
    lists = materialize(entries.mapInArrow(releasing(_lists), "token long, class long, n int, need int"), "jaccard-all-lists")
    needs = lists.groupBy("class").agg(F.array_sort(F.collect_list("need")).alias("needs"))  # no more than a prefix holds
    can = needs.where(F.exists(F.transform("needs", lambda v, i: v <= i + 1), lambda x: x)).select("class")
    out = materialize(lists.join(can, "class", "left_semi").select("token", "class", "n"), "jaccard-lists")
    discard(lists)
    return sets, classes, out


_FITS = f"{DEN} * least(n, hub_n) >= {NUM} * greatest(n, hub_n)"


def _allowed(differ: str) -> str:
    """SQL: whether sets of n and hub_n shingles of which so many differ at least can link."""
    joint = "(n + hub_n)"
    return f"{differ} <= {joint} - 2 * (({NUM} * {joint} + {NUM + DEN - 1}) div {NUM + DEN})"


def _filtered(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of distinct pairs(class, hub, n, hub_n) those whose bitmaps allow a link, as (a, b) with a < b."""
    x, y = classes.select("class", F.col("bits").alias("x")), classes.select(F.col("class").alias("hub"), F.col("bits").alias("y"))
    differ = "aggregate(zip_with(x, y, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v)"
    return pairs.join(x, "class").join(y, "hub").where(_allowed(differ)).select(F.least("class", "hub").alias("a"), F.greatest("class", "hub").alias("b"))


def _stars(members: DataFrame, round_: int) -> DataFrame:
    """Distinct pairs (class, hub, n, hub_n) of members(token, class, n, comp) with HUBS classes of their list from other groups."""
    draw = lambda i: F.min(F.struct(F.xxhash64("class", F.lit(HUBS * round_ + i)).alias("h"), F.col("class").alias("hub"), F.col("n").alias("hub_n"), F.col("comp").alias("hub_comp")))
    hubs = members.groupBy("token").agg(F.array_distinct(F.array(*[F.struct(d["hub"].alias("hub"), d["hub_n"].alias("hub_n"), d["hub_comp"].alias("hub_comp")) for d in map(draw, range(HUBS))])).alias("hubs"))
    pairs = members.join(hubs, "token").select("class", "n", "comp", F.inline("hubs")).where(f"comp <> hub_comp and {_FITS}")
    return pairs.select("class", "hub", "n", "hub_n").distinct()


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, key, n, class), and for each class the row (doc_id, key) that stands for its group."""
    with small_batches(docs.sparkSession):
        sets, classes, lists = _entries(docs)
        in_group = lambda g: classes.join(g.toDF("class", "comp"), "class", "left").withColumn("comp", F.coalesce("comp", "class"))
        members, links, group, round_, rows = lists.withColumn("comp", F.col("class")), None, None, 0, lists.count()
        while True:
            found = _verified(_filtered(_stars(members, round_), classes), docs, classes, "star")
            joined = found.limit(1).count()
            if joined or group is None:
                links = found if links is None else links.union(found)
                group = materialize(components(links), "jaccard-groups")
                members = lists.join(in_group(group).select("class", "comp"), "class")
                members = materialize(_open(members), "jaccard-open")
            own = members.groupBy("token", "comp").count().groupBy("token").agg(F.sum("count").alias("n"), F.sum(F.col("count").cast("double") * F.col("count")).alias("s"))
            left = own.agg(F.sum((F.col("n").cast("double") * F.col("n") - F.col("s")) / 2).alias("pairs")).first()
            round_ += 1
            if not joined or (left.pairs or 0) <= PAIRS_A_ROW * rows:
                break
        more = _verified(_pairs(members, classes, "comp <> hub_comp"), docs, classes, "rest")
        if more.limit(1).count():
            group = materialize(components(links.union(more)), "jaccard-groups")
        of = materialize(in_group(group), "jaccard-of")
        stands = of.groupBy("comp").agg(F.min("row").alias("row"))
        return sets, materialize(of.select("class", "comp").join(stands, "comp").select("class", "row"), "jaccard-found")


def _open(members: DataFrame) -> DataFrame:
    """Of members(token, class, n, comp) the lists of several groups, with their length and the least and largest n in them."""
    of = members.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("length"), F.min("n").alias("low"), F.max("n").alias("high"))
    return members.join(of.where("x <> y").drop("x", "y"), "token")


def _shared(n: str, m: str) -> str:
    """SQL: least_shared(n, m)."""
    return f"(({NUM} * ({n} + {m}) + {NUM + DEN - 1}) div {NUM + DEN} - ({NUM} * greatest({n}, {m}) + {DEN - 1}) div {DEN} + 1)"


def _pairs(members: DataFrame, classes: DataFrame, more: str) -> DataFrame:
    """Pairs (a, b) of classes that share a list and may link by their sizes and bitmaps. members: as _open() returns them."""
    order = Window.partitionBy("class").orderBy(F.desc("length"), F.desc("token"))
    # left: listed shingles of the class from this one on; earlier: those just before it
    own = members.withColumn("left", F.row_number().over(order)).withColumn("earlier", F.collect_list("token").over(order.rowsBetween(1, EARLIER)))
    least = f"least(n, greatest(low, ({NUM} * n + {DEN - 1}) div {DEN}))", f"greatest(n, least(high, {DEN} * n div {NUM}))"
    own = own.where(f"left >= least({_shared('n', least[0])}, {_shared('n', least[1])}) - 1")  # with any size between, see _lists()
    own = own.join(classes.select("class", *_BITMAP), "class").select("token", "class", "n", "comp", "left", "earlier", *_BITMAP)
    x, y = own.alias("x"), own.withColumnsRenamed({c: f"hub_{c}" for c in ("n", "comp", "left", "earlier")} | {"class": "hub"}).alias("y")
    differ = " + ".join(f"bit_count(x.{b} ^ y.{b})" for b in _BITMAP)
    first = f"least(left, hub_left) >= {_shared('n', 'hub_n')} and not arrays_overlap(earlier, hub_earlier)"
    fits = F.expr(f"x.token = y.token and class < hub and {more} and {_FITS} and {_allowed(differ)} and {first}")
    return _filtered(x.join(y, fits).select("class", "hub", "n", "hub_n").distinct(), classes)


def jaccard_links(docs: DataFrame) -> DataFrame:
    """All links between different sets, as (a, b), a < b: the least doc_id of each set (null if none has one). As many rows as there are links, so quadratic in a group of near copies; jaccard_groups is not."""
    with small_batches(docs.sparkSession):
        docs = _texts(docs)
        _, classes, lists = _entries(docs)
        links = _verified(_pairs(_open(lists.withColumn("comp", F.col("class"))), classes, "true"), docs, classes, "all")
        one = lambda c: classes.select(F.col("class").alias(c), F.col("row.doc_id").alias(f"{c}_id"))
        ends = links.join(one("u"), "u").join(one("v"), "v")
        return ends.select(F.least("u_id", "v_id").alias("a"), F.when(F.col("u_id").isNotNull() & F.col("v_id").isNotNull(), F.greatest("u_id", "v_id")).alias("b"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def jaccard_groups(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text). Returns a row for each document: doc_id, n_shingles, component_id, class (null without words)."""
    sets, found = _grouped(_texts(docs))
    own = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("row.doc_id"))
    return sets.join(small(found, BROADCAST_ROWS), "class", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "class")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without all but one row of each group: that with the smallest doc_id (null last) stays, of those that with the smallest hash of its text. Texts without words stay; rows that repeat a doc_id and a text are one document."""
    sets, found = _grouped(_texts(docs))
    rows = sets.join(small(found, BROADCAST_ROWS), "class", "left")
    stands = F.col("doc_id").eqNullSafe(F.col("row.doc_id")) & (F.col("key") == F.col("row.key"))
    rows = materialize(rows.select("class", F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key"), (F.col("class").isNull() | stands).alias("stays")), "jaccard-rows")
    gone = materialize(rows.where("not stays").select("gone_id", "gone_key").distinct(), "jaccard-gone")
    twice = rows.where("stays and (class is not null or gone_id is not null)").groupBy("gone_id", "gone_key").count().where("count > 1").drop("count")
    twice = materialize(twice, "jaccard-twice")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("gone_id")) & (_key("text") == F.col("gone_key"))
    kept = docs.join(small(gone, BROADCAST_ROWS), same, "left_anti")
    if not twice.limit(1).count():
        return kept
    twice = small(twice, BROADCAST_ROWS)
    return kept.join(twice, same, "left_anti").union(kept.join(twice, same).dropDuplicates(["gone_id", "gone_key"]).select(*docs.columns))
