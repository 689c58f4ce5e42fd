"""Best-fit packing of token sequences, improved by swap-based local search.

Texts become token ids plus an end id; those longer than a sequence are cut. All that packing needs is
how many pieces there are of each length, CAPACITY numbers for a corpus of any size. From them the
driver makes a plan of bin patterns with counts: best-fit decreasing, many like bins at a time, then
local search that moves documents, or exchanges one for one or two for one, from the emptiest bins
into fuller ones as long as the sum of squared fills grows, until the lower bound (all tokens over
CAPACITY, and pieces of over half of it) is met or no such exchange is left. Each piece then finds its bin from its rank among the pieces of
its length: the rank within its task, counted there, plus the count of the tasks before.

Nulls and empty texts: the end id alone, one piece. Rows that repeat a doc_id are packed each; a null
doc_id stays null. An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.memory import releasing, small_batches
from webloom.llm.shingles import blocks, column_bytes
from webloom.storage import materialize, small

CAPACITY = 4096
END_ID = 1
WORDS = 1 << 19  # words whose ids a worker remembers, about
OFFSET_ROWS = 500_000
_U = np.uint64
_PLAIN = re.compile(r"([^\W\d_]*)([!-&(-/:-@\[-`{-~]*)")
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.zeros(256, dtype=bool)
_ODD[28:32] = True  # white space to one library only
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = (_LOWER >= 97) & (_LOWER <= 122)
_SIGN = np.zeros(256, dtype=bool)
_SIGN[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True  # all of ASCII but the apostrophe
_KEEP = [np.array([0] * (8 * i) + [(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1] * (17 - 8 * i), dtype=np.uint64) for i in range(3)]  # by length: the bytes of the i-th part of a key


class _Model:
    """Ids of a part of a text without white space about it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.model = self.t.model
        # the byte-level alphabet: printable Latin-1 stands for itself, other bytes for U+0100 and on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in own)}

    def whole(self, text: str) -> list[int]:
        return self.t.encode(text, add_special_tokens=False).ids

    def part(self, p: bytes) -> list[int]:
        """A run of small letters or of signs, by the tokenizer's model alone."""
        return [x.id for x in self.model.tokenize(p.decode() if p.isascii() else p.decode("latin-1").translate(self.byte))]

    def ids(self, part: bytes) -> list[int]:
        if part.isalpha() and part.islower():  # ASCII alone
            return self.part(part)
        ids: list[int] = []
        for w in part.decode().split():  # other white space may stand in it
            m = _PLAIN.fullmatch(w)
            # up to U+017F there is nothing to compose, and lower case goes by letter but for U+0130
            if m and (w.isascii() or max(w) < "\u0180" and "\u0130" not in w and m[1].isalpha()):
                ids += (self.part(m[1].lower().encode()) if m[1] else []) + (self.part(m[2].encode()) if m[2] else [])
            else:
                ids += self.whole(w)
        return ids


def _parts(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """raw with Latin-1 letters in lower case, and the starts and sizes of its parts between white space: words of letters, their closing signs, and whole words of other make."""
    low = _LOWER[raw]
    accent = np.flatnonzero(raw[:-1] == 0xC3) + 1  # U+00C0 to U+00FF
    letter, sign = _LETTER[raw], _SIGN[raw]
    second = raw[accent]
    ok = (second != 0x97) & (second != 0xB7)  # the two signs among them
    letter[accent[ok]] = letter[accent[ok] - 1] = True
    up = accent[ok & (second < 0x9F)]
    low[up] += 0x20
    solid = np.zeros(len(raw) + 1, dtype=np.int8)
    solid[1:] = ~_SPACE[raw]
    edge = np.diff(solid)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    until = np.zeros(len(raw) + 1, dtype=np.int32)
    np.cumsum(letter, out=until[1:])
    body = until[ends] - until[starts]
    all_first = until[starts + body] - until[starts] == body
    np.cumsum(sign, out=until[1:])
    tail = until[ends] - until[starts]
    plain = all_first & (body + tail == ends - starts)
    both = np.empty(2 * len(starts), dtype=np.int64)
    sizes = np.empty(2 * len(starts), dtype=np.int64)
    sizes[::2] = np.where(plain, body, ends - starts)
    sizes[1::2] = np.where(plain, tail, 0)
    both[::2], both[1::2] = starts, starts + sizes[::2]
    other = np.flatnonzero(~plain)
    for x, y in zip(starts[other].tolist(), ends[other].tolist(), strict=True):
        low[x:y] = raw[x:y]
    some = sizes > 0
    return low, both[some], sizes[some]


class Encoder:
    """Ids of texts. Words between white space are encoded apart (the tokenizer drops white space first and joins nothing across it) and remembered.

    The words of many texts are looked up at once, in a hash table with linear probing whose keys are
    the words' own bytes (up to KEY of them), so that a hit is the same word for certain. Longer
    words are kept in a dictionary. Texts with special tokens or odd white space are encoded whole.
    """

    KEY = 24

    def __init__(self, path: str, words: int = WORDS):
        self.model, self.limit = _Model(path), words
        self._clear(2 * words)

    def _clear(self, slots: int) -> None:
        self.keys = np.zeros((1 << (slots - 1).bit_length(), 4), dtype=np.uint64)  # three parts of a word, entry + 1 and above it the word's size
        self.long: dict[bytes, int] = {}
        self.pool, self.used, self.entries = np.empty(4 * self.limit, dtype=np.uint32), 0, 0
        self.at, self.n, self.uses = (np.zeros(2 * self.limit, dtype=np.int32) for _ in range(3))

    def _insert(self, rows: np.ndarray) -> None:
        """Rows of keys that the table lacks."""
        if self.entries > 3 * len(self.keys) // 4:
            rows = np.concatenate([self.keys[self.keys[:, 3] > 0], rows])
            self.keys = np.zeros((2 * len(self.keys), 4), dtype=np.uint64)
        slot = self._slot(rows[:, :3].T)
        while len(rows):
            free = np.flatnonzero(self.keys[slot, 3] == 0)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]] = rows[won]
            left = np.ones(len(rows), dtype=bool)
            left[won] = False
            rows, slot = rows[left], (slot[left] + 1) & (len(self.keys) - 1)

    def _slot(self, parts) -> np.ndarray:
        h = parts[0] * _U(0x9E3779B97F4A7C15)
        for x in parts[1:]:
            h = ((h ^ (h >> _U(31))) + x) * _U(0xD6E8FEB86659FD93)
        return ((h ^ (h >> _U(32))) & _U(len(self.keys) - 1)).astype(np.int64)

    def _trim(self) -> None:
        """Keep the words that came again, if they are not too many."""
        rows = self.keys[self.keys[:, 3] > 0]
        e = (rows[:, 3] & _U((1 << 40) - 1)).astype(np.int64) - 1
        again = self.uses[e] > 1
        rows, e = rows[again], e[again]
        pool, at, n = self.pool, self.at[e], self.n[e]
        self._clear(2 * self.limit)
        if len(rows) > self.limit // 2:
            return
        until = np.concatenate([[0], np.cumsum(n)])
        self.used, self.entries = int(until[-1]), len(rows)
        self.pool[: self.used] = pool[np.repeat(at - until[:-1], n) + np.arange(self.used)]
        self.at[: len(e)], self.n[: len(e)] = until[:-1], n
        rows[:, 3] = (rows[:, 3] >> _U(40) << _U(40)) + np.arange(1, len(rows) + 1, dtype=np.uint64)
        self._insert(rows)

    def _add(self, found: list[list[int]]) -> int:
        """New entries with these ids; the number of the first."""
        e, n = self.entries, np.array([len(x) for x in found], dtype=np.int32)
        self.entries += len(found)
        while self.entries > len(self.at):
            self.at, self.n, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.n, self.uses))
        until = self.used + int(n.sum())
        while until > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        self.at[e : self.entries], self.n[e : self.entries] = self.used + np.cumsum(n) - n, n
        self.pool[self.used : until] = np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=until - self.used)
        self.used = until
        return e

    def _find(self, low: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The entry of each part of low (which has KEY bytes to spare)."""
        eight = np.lib.stride_tricks.as_strided(low[:8].view(np.uint64), (len(low) - 7,), (1,))
        short = np.minimum(sizes, self.KEY)
        parts = [eight[starts + 8 * i] & _KEEP[i][short] for i in range(3)]
        slot = self._slot(parts)
        out = np.full(len(starts), -1, dtype=np.int64)
        todo = np.flatnonzero(sizes <= self.KEY)
        probe, missed = slot[todo], []
        while len(todo):
            row = self.keys[probe]
            free = row[:, 3] == 0
            hit = (row[:, 3] >> _U(40) == sizes[todo].astype(np.uint64)) & ~free
            for i in range(3):
                hit &= row[:, i] == parts[i][todo]
            out[todo[hit]] = (row[hit, 3] & _U((1 << 40) - 1)).astype(np.int64) - 1
            missed.append(todo[free])
            rest = ~(hit | free)
            todo, probe = todo[rest], (probe[rest] + 1) & (len(self.keys) - 1)
        missed = np.concatenate([*missed, np.flatnonzero(sizes > self.KEY)])
        new: dict[bytes, int] = {}
        first, found, begin = [], [], self.entries
        data = low.tobytes() if len(missed) else b""
        for i, a, n in zip(missed.tolist(), starts[missed].tolist(), sizes[missed].tolist(), strict=True):
            w = data[a : a + n]
            known = new if n <= self.KEY else self.long
            e = known.get(w)
            if e is None:
                e = known[w] = begin + len(found)
                found.append(self.model.ids(w))
                if n <= self.KEY:
                    first.append(i)
            out[i] = e
        if found:
            self._add(found)
        if first:
            self._insert(np.stack([*(x[first] for x in parts), (out[first] + 1 + (sizes[first] << 40)).astype(np.uint64)], axis=1))
        return out

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (and the last one's end)."""
        if self.entries > self.limit:
            self._trim()
        raw = np.frombuffer(b" ".join([*texts, b" " * self.KEY]), dtype=np.uint8)
        begin = np.cumsum([0] + [len(t) + 1 for t in texts])
        low, starts, sizes = _parts(raw)
        odd = np.flatnonzero(_ODD[raw])
        sign = np.flatnonzero(raw[:-1] == 60)
        odd = np.concatenate([odd, sign[raw[sign + 1] == 124]])  # <| begins special tokens
        whole = np.unique(np.searchsorted(begin, odd, side="right") - 1)
        if len(whole):
            own = np.isin(np.searchsorted(begin, starts, side="right") - 1, whole)
            own[np.searchsorted(starts, begin[whole])] = False  # the first part stands for the text
            starts, sizes = starts[~own], sizes[~own]
        entry = self._find(low, starts, sizes)
        for t in whole.tolist():
            entry[np.searchsorted(starts, begin[t])] = self._add([self.model.whole(texts[t].decode())])
        self.uses[: self.entries] += np.bincount(entry, minlength=self.entries).astype(np.int32)
        n = self.n[entry]
        until = np.concatenate([[0], np.cumsum(n)])
        ids = self.pool[np.repeat(self.at[entry] - until[:-1], n) + np.arange(until[-1])]
        return ids, until[np.searchsorted(starts, begin)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder; kept from task to task."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches):
        task, rank = TaskContext.get().partitionId(), Counter()
        for b in batches:
            texts = column_bytes(b.column(1))
            for x, y in blocks(texts):
                own, until = encoder(path).encode(texts[x:y])
                size = np.diff(until) + 1
                begin = np.concatenate([[0], np.cumsum(size)])
                ids = np.full(begin[-1], end_id, dtype="<u4")
                ids[np.arange(len(own)) + np.repeat(np.arange(y - x), size - 1)] = own
                n = -(-size // capacity)
                doc = np.repeat(np.arange(y - x), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(size[doc] - start, capacity)
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[4 * i : 4 * (i + k)]) for i, k in zip((begin[doc] + start).tolist(), length.tolist(), strict=True)]
                ranks = []
                for k in length.tolist():
                    ranks.append(rank[k])
                    rank[k] += 1
                ids = [b.column(0).slice(x, y - x).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(ranks, pa.int64()), pa.array(np.full(len(doc), task, dtype=np.int64))]
                yield pa.RecordBatch.from_arrays(ids, names=["doc_id", "piece", "start", "length", "ids_crc32", "rank", "task"])

    return run


class Bins:
    """Kinds of bins (sorted lengths) with counts, by free space."""

    def __init__(self, capacity: int):
        self.capacity, self.kinds, self.free = capacity, {}, []

    def add(self, kind: tuple[tuple[int, int], ...], count: int) -> None:
        if count:
            room = self.capacity - sum(x * k for x, k in kind)
            if room not in self.kinds:
                self.kinds[room] = Counter()
                insort(self.free, room)
            self.kinds[room][kind] += count

    def take(self, room: int, kind=None, count: int | None = None):
        kinds = self.kinds[room]
        kind = kind if kind is not None else next(iter(kinds))
        count = kinds[kind] if count is None else count
        kinds[kind] -= count
        if not kinds[kind]:
            del kinds[kind]
        if not kinds:
            del self.kinds[room]
            self.free.pop(bisect_left(self.free, room))
        return kind, count

    def total(self) -> int:
        return sum(sum(k.values()) for k in self.kinds.values())


def best_fit(counts: dict[int, int], capacity: int) -> Bins:
    """Best-fit decreasing; like bins are filled together."""
    bins = Bins(capacity)
    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect_left(bins.free, size)
            room = bins.free[at] if at < len(bins.free) else capacity
            kind, c = bins.take(room) if at < len(bins.free) else ((), n)
            k = room // size
            full = min(c, n // k)
            bins.add((*kind, (size, k)), full)
            n -= full * k
            c -= full
            if n and c:
                bins.add((*kind, (size, n)), 1)
                n, c = 0, c - 1
            if kind:
                bins.add(kind, c)
    return bins


def _without(kind, *sizes):
    left = Counter(dict(kind))
    left.subtract(sizes)
    return +left


def _sorted(items: Counter):
    return tuple(sorted(items.items(), reverse=True))


class _Underfull:
    """Kinds of bins that aren't full, with counts: by[x] has (room, kind) of those that hold a piece of x, by[0] of all, in order."""

    def __init__(self, bins: Bins):
        self.capacity, self.count, self.by = bins.capacity, {}, {0: []}
        self.most = np.full(bins.capacity + 1, -1, dtype=np.int64)  # the most room beside a piece of x
        for room in bins.free:
            for kind, n in bins.kinds[room].items():
                if room:
                    self.add(kind, n)

    def room(self, kind) -> int:
        return self.capacity - sum(x * k for x, k in kind)

    def add(self, kind, n: int) -> None:
        room = self.room(kind)
        if kind and room:
            if kind not in self.count:
                for x in (0, *(x for x, _ in kind)):
                    insort(self.by.setdefault(x, []), (room, kind))
                    self.most[x] = self.by[x][-1][0]
            self.count[kind] = self.count.get(kind, 0) + n

    def take(self, kind, n: int) -> None:
        self.count[kind] -= n
        if not self.count[kind]:
            del self.count[kind]
            at = (self.room(kind), kind)
            for x in (0, *(x for x, _ in kind)):
                self.by[x].pop(bisect_left(self.by[x], at))
                self.most[x] = self.by[x][-1][0] if self.by[x] else -1

    def exchange(self, a):
        """The most gainful exchange of a bin of kind a: (gain, kind b, pieces out of a, pieces out of b); None if none gains."""
        room_a, own, best = self.room(a), [x for x, _ in a], None
        gives = {(x,): x for x in own} | {(x, y): x + y for i, x in enumerate(own) for y in own[i if a[i][1] > 1 else i + 1 :]}
        for out, size in gives.items():
            size_ = min(size, self.capacity + 1)
            for y in np.flatnonzero(self.most[:size_] >= size - np.arange(size_)).tolist():
                if len(out) > 1 and not y:
                    continue  # two moves
                i = bisect_left(self.by[y], (size - y,))
                if i < len(self.by[y]) and self.by[y][i][1] == a and self.count[a] < 2:
                    i += 1
                if i < len(self.by[y]):
                    room_b, b = self.by[y][i]  # the fullest that has room
                    gain = (size - y) * (room_a - room_b + size - y)
                    if gain > 0:
                        best = max(best or (0,), (gain, b, out, (y,) if y else ()), key=lambda x: x[0])
                        break
        return best


def improve(bins: Bins, least: int) -> Bins:
    """Local search from the emptiest bins on, until there are least bins or no exchange gains; each step treats all bins of two kinds together."""
    under, total, gained = _Underfull(bins), bins.total(), True
    full = Bins(bins.capacity)
    for kind, n in bins.kinds.get(0, {}).items():
        full.add(kind, n)
    while gained and total > least:
        gained = False
        todo = [kind for _, kind in under.by[0]]
        while todo and total > least:
            a = todo.pop()
            if a not in under.count or not (best := under.exchange(a)):
                continue
            _, b, out, back = best
            n = under.count[a] // 2 if a == b else min(under.count[a], under.count[b])
            under.take(a, n)
            under.take(b, n)
            new_a, new_b = _sorted(_without(a, *out) + Counter(back)), _sorted(_without(b, *back) + Counter(out))
            total -= 0 if new_a else n
            for kind in (new_a, new_b):
                if kind and not under.room(kind):
                    full.add(kind, n)
                else:
                    under.add(kind, n)
            todo += [x for x in (a, new_a) if x in under.count]
            gained = True
    for kind, n in under.count.items():
        full.add(kind, n)
    return full


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: ranks at which runs begin, pieces of that length in each bin of the run, its first bin, their offset there."""
    bins = best_fit(counts, capacity)
    long = sum(n for s, n in counts.items() if 2 * s > capacity)  # no two of them share a bin
    bins = improve(bins, max(long, -(-sum(s * n for s, n in counts.items()) // capacity)))
    runs: dict[int, list] = {s: [] for s in counts}
    used, base = Counter(), 0
    for room in bins.free:
        for kind, n in bins.kinds[room].items():
            at = 0
            for size, k in kind:
                runs[size].append((used[size], k, base, at))
                used[size] += k * n
                at += size * k
            base += n
    return {s: tuple(np.array(x, dtype=np.int64) for x in zip(*r, strict=True)) for s, r in runs.items()}


def _placed(found):
    def run(batches):
        for b in batches:
            size, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            seq, off = np.empty(len(size), dtype=np.int64), np.empty(len(size), dtype=np.int64)
            for s in np.unique(size):
                own = size == s
                first, k, base, at = found[int(s)]
                r = rank[own]
                i = np.searchsorted(first, r, side="right") - 1
                seq[own] = base[i] + (r - first[i]) // k[i]
                off[own] = at[i] + (r - first[i]) % k[i] * s
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. tokenizer: the path of its file."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, rank long, task long"
    with small_batches(docs.sparkSession):
        pieces = materialize(docs.mapInArrow(releasing(_pieces(tokenizer, capacity, end_id)), kinds), "pieces")
    counts = materialize(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    found = plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)  # capacity rows at most
    w = Window.partitionBy("length").orderBy("task")
    before = materialize(counts.select("task", "length", (F.sum("n").over(w) - F.col("n")).alias("before")), "piece-offsets")
    ranked = pieces.join(small(before, OFFSET_ROWS), ["task", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(releasing(_placed(found)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
