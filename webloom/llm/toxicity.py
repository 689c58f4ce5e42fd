"""Toxicity by a weighted lexicon matched with Aho-Corasick on folded text.

Folding: NFKC, lower case, letters that look like Latin ones, digits and signs that stand for
letters inside a word, and i/l/1/!/| as one letter; everything else becomes one space. A word with a
letter and such digits or signs is tried as it stands, with them folded, and with those at its ends
dropped or folded; the form that weighs most counts. Words without any letter stay as they are. The lexicon
has whole words and word beginnings with log-odds weights, learned from labelled documents, over a
short list of common insults for words that the labels do not cover. Hits inside an exception
phrase do not count. The weighted sum, as it is and per hundred words, goes through a logistic
curve fitted on labelled documents that the lexicon was not learned from.

Learning reads LABELLED documents of each label at most (those with the smallest hash of doc_id) and
never a held-out one (crc32 of doc_id as text mod 5 is 0). Every document is scored on its whole
text. Null and empty texts score as a text without hits. Rows that repeat a doc_id are each scored.
A null doc_id or label is never learned from. Without usable labels, the short list and a fixed
curve hold. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.memory import releasing, small_batches
from webloom.storage import materialize

LABELLED = 4000  # of each label, for fitting
TERMS = 4000  # in the lexicon
PICKED = 50_000  # words whose form a worker remembers

# Common insults.
INSULTS = "idiot idiots moron morons stupid imbecile dumbass loser losers scum scumbag trash worthless pathetic disgusting clown clowns jerk bastard vermin filth retard degenerate dimwit halfwit lowlife".split()
# Phrases in which such words are harmless.
EXCEPTIONS = ["trash can", "trash cans", "trash bin", "trash bag", "trash bags", "trash collection", "trash pickup", "clown fish", "circus clown", "pond scum", "soap scum", "class clown", "stupid question", "sore loser"]
# Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("абвгдеѕзіјкӏмнорԛстуԝхүαβεικνορτυχωɑɡƒııøłđħðþ", "abbrdes3ijklmhopqctywxyabeiknoptuxwagfiioldhdp", strict=True))
# Digits and signs used for letters.
SIGNS = dict(zip("0134578@$!|€+", "oieastbasiiet", strict=True))

_LOOK = str.maketrans(LOOKALIKES)
_SIGN = str.maketrans(SIGNS)
_MIXED = re.compile(r"\S*[0134578@$!|€+]\S*")
_SPELLED = re.compile(r"(?<!\w)(?:[^\W\d_][.\-_*]){3,}[^\W\d_](?!\w)")
_OTHER = re.compile(r"[\W\d_]+")
_MARKS = ".,;:?()[]\"'"
_ENDS = _MARKS + "!|+"  # at the ends of a word more often punctuation than letters


def forms(word: str) -> list[str]:
    """The ways to read a word with such digits or signs, each once; first the folded one if half of the word is letters, else the word as it stands."""
    if not any(map(str.isalpha, word)):
        return [word]
    t = word.strip(_ENDS)
    lead, trail = word.lstrip(_MARKS).rstrip(_ENDS), word.lstrip(_ENDS).rstrip(_MARKS)
    folded = t.translate(_SIGN)
    first = [folded, word] if 2 * sum(map(str.isalpha, t)) >= len(t) else [word, folded]
    return [*dict.fromkeys([*first, lead.translate(_SIGN), trail.translate(_SIGN), word.strip(_MARKS).translate(_SIGN)])]


def _spaced(text: str) -> str:
    if "." in text or "-" in text or "*" in text or "_" in text:
        text = _SPELLED.sub(lambda m: re.sub(r"\W|_", "", m[0]), text)
    return f" {_OTHER.sub(' ', text).strip()} ".replace("l", "i")


def fold(text: str, pick=lambda word: forms(word)[0]) -> str:
    """' word word ... ': the folded words of a text, each between spaces. pick: what to put for a word that has several forms."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).lower().translate(_LOOK)
    return _spaced(_MIXED.sub(lambda m: pick(m[0]), text.lower()))


def terms_of(folded: str) -> set[str]:
    """The words of a folded text (' word ') and their beginnings of 4 to 8 letters (' word')."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in range(4, min(8, len(w)) + 1))
    return out


def _count_terms(batches):
    for b in batches:
        toxic, clean = Counter(), Counter()
        for text, label in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            (toxic if label else clean).update(terms_of(fold(text.as_py() or "", lambda word: " ".join(forms(word)))))
        every = [*(toxic.keys() | clean.keys())]
        yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([toxic[t] for t in every], pa.int64()), pa.array([clean[t] for t in every], pa.int64())], names=["term", "toxic", "clean"])


class Lexicon:
    """Weighted terms, exception phrases and the curve from their weights to a score."""

    def __init__(self, weights: dict[str, float], curve=(-4.0, 2.0, 1.0)):
        self.weights, self.curve, self._found, self._picked = weights, curve, None, {}

    def __getstate__(self):
        return self.__dict__ | {"_found": None, "_picked": {}}

    def automaton(self):
        if self._found is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for t, w in self.weights.items():
                a.add_word(t, (len(t), w))
            for e in EXCEPTIONS:
                a.add_word(e := fold(e), (len(e), None))
            a.make_automaton()
            self._found = a
        return self._found

    def hits(self, folded: str) -> dict[int, float]:
        """The weights of the hits outside exception phrases by their place. Of hits at one word the heaviest counts."""
        best: dict[int, float] = {}
        but: list[tuple[int, int]] = []
        for end, (n, w) in self.automaton().iter(folded):
            at = end - n + 1
            if w is None:
                but.append((at, end))
            elif w > best.get(at, 0):
                best[at] = w
        if but:
            best = {at: w for at, w in best.items() if not any(a <= at < b for a, b in but)}
        return best

    def pick(self, word: str) -> str:
        """Of a word's forms the one that weighs most, the first of such."""
        found = self._picked.get(word)
        if found is None:
            every = forms(word)
            found = every[0] if len(every) == 1 else max(every, key=lambda x: sum(self.hits(_spaced(x)).values()))
            if len(word) <= 40:
                if len(self._picked) >= PICKED:
                    self._picked.clear()
                self._picked[word] = found
        return found

    def weigh(self, text: str) -> tuple[float, int]:
        """The summed weight of the hits, and the number of words."""
        folded = fold(text, self.pick)
        best = self.hits(folded)
        return sum(best.values()), folded.count(" ") - 1

    def features(self, text: str) -> tuple[float, float]:
        w, n = self.weigh(text)
        return math.log1p(w), math.log1p(100 * w / max(n, 20))

    def score(self, text: str) -> float:
        a, x, y = self.curve
        f = self.features(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + x * f[0] + y * f[1]))))


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 0.05) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the first column's weight is the constant."""
    x = np.column_stack([np.ones(len(x)), x])
    w, pen = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    balance = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (balance * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + pen
        w = w - np.linalg.solve(h, x.T @ (balance * (p - y)) + pen @ w)
    return w


def choose(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Terms with their log-odds of the document counts; of terms that begin alike, a longer one only if it weighs clearly more."""
    learned, support = {}, {t: x for t, x, _ in counts}
    for t, x, y in counts:
        w = math.log((x + 0.5) / (toxic + 1)) - math.log((y + 0.5) / (clean + 1))
        if x >= max(3, 0.015 * toxic) and w > 1.5 and y <= 0.05 * x:
            learned[t] = w
    for t in [*learned]:  # of beginnings that the same documents have, the longest is the most telling
        for k in range(5, len(t)):
            if support.get(t[:k], 0) * 0.95 <= support[t]:
                learned.pop(t[:k], None)
    seen = {t for t, _, _ in counts}
    weights: dict[str, float] = {}
    for t, w in sorted(learned.items(), key=lambda p: (len(p[0]), -p[1], p[0])):
        if w > 1.25 * max((weights.get(t[:k], 0) for k in range(5, len(t))), default=0):
            weights[t] = w
    weights = dict(sorted(weights.items(), key=lambda p: (-p[1], p[0]))[:TERMS])
    for t in INSULTS:
        if (t := fold(t)) not in seen:
            weights.setdefault(t, 3.0)
    return weights


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """docs(doc_id, text), labels(doc_id, toxic)."""
    labels = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("doc_id is not null and toxic in (0, 1)").where(~held_out()).dropDuplicates(["doc_id"])
    picked = None
    for label in (0, 1):
        own = labels.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
        picked = own if picked is None else picked.union(own)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(picked), "doc_id")
    rows = materialize(rows.select("text", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) == 0).alias("tune")), "toxic-sample")
    learn = rows.where("not tune").select("text", "toxic")
    n = {r.toxic: r["count"] for r in learn.groupBy("toxic").count().collect()}
    counts = learn.repartition(8).mapInArrow(releasing(_count_terms), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic >= 3")
    counts = counts.orderBy(F.desc(F.log(F.col("toxic") + 0.5) - F.log(F.col("clean") + 0.5)), F.desc("toxic"), "term").limit(8 * TERMS)
    lexicon = Lexicon(choose([(r.term, r.toxic, r.clean) for r in counts.collect()], n.get(1, 0), n.get(0, 0)))

    def features(batches):
        for b in batches:
            f = [lexicon.features(t or "") for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in f]), pa.array([x[1] for x in f]), b.column(1)], names=["a", "b", "toxic"])

    tune = rows.where("tune").select("text", "toxic").mapInArrow(releasing(features), "a double, b double, toxic int").collect()  # LABELLED / 2 rows or so
    y = np.array([r.toxic for r in tune], dtype=float)
    if len(y) and 0 < y.sum() < len(y):
        lexicon.curve = tuple(map(float, logistic(np.array([[r.a, r.b] for r in tune]), y)))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """A row for each document: doc_id, held_out, score, predicted."""

    def run(batches):
        for b in batches:
            s = [lexicon.score(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    with small_batches(docs.sparkSession):
        scored = materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(releasing(run), "doc_id long, score double"), "toxic-scores")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """docs without those that the lexicon predicts to be toxic, as a written table; all columns stay."""
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([lexicon.score(t.as_py() or "") < 0.5 for t in b.column(at)], pa.bool_()))

    with small_batches(docs.sparkSession):
        return materialize(docs.mapInArrow(releasing(run), schema), "not-toxic")
