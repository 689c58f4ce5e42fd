"""Secret scan, in DataFrame and SQL operations only: known shapes, and a battery of randomness tests.

Known shapes are matched leftmost without overlap; a match that is too short is dropped afterwards.
Further candidates are tokens of MIN_TOKEN characters or more with letters and digits. Each gets an
encoding (hex, base32, upper- or lower-case alphanumeric, base64) and two verdicts:
 - Is it ordinary? The null hypothesis is that it is: its characters are drawn as in names and words
   (letters as often as in text, few capitals and digits). The sum of the log-likelihood ratios of
   uniform to ordinary characters gives a p-value by its mean and variance under that hypothesis.
   Within each length band over the whole corpus, Benjamini-Hochberg rejects the hypothesis at FDR:
   of the tokens so found at most that share are ordinary ones. p-values are counted in steps and
   rounded up to the step's edge, so the count of rejections can only fall.
 - Is it random? Three tests on the values of its characters in the alphabet: chi-squared uniformity
   over bins of five expected values or more, runs about the middle, and serial correlation; Fisher's
   method combines the three p-values. Counters, dates and patterns fall below LEVEL.
A token found by the first and not refused by the second is a secret (kind random), unless it
overlaps a known shape.

Positions are code points, ends exclusive. A null text is empty and has no spans. Rows that repeat a
doc_id each return. Other columns are ignored by the scan and kept by redact().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.storage import materialize

# The shapes.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # runs are maximal, so this equals runs of any length of which those under 24 are dropped
MIN_TOKEN = 20
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
FDR = 0.01
LEVEL = 0.01  # of the battery
PART = 512  # hits that are put together before they join the others of their text
STEPS = 60  # of a factor of 10^-0.25 each
KINDS = ["assign", "access", "hex", "random"]
# Encodings by pattern, most particular first, with their alphabets.
ENCODINGS = [
    (r"^[0-9a-f]+$", "0123456789abcdef"),
    (r"^[0-9A-F]+$", "0123456789ABCDEF"),
    (r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    (r"^[A-Z0-9]+=*$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (r"^[a-z0-9]+=*$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    (r".", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
]


# Letters by their usual share in English text, in percent; the shares of small letters, capitals, digits and signs in ordinary names.
LETTERS = dict(zip("etaoinshrdlcumwfgypbvkjxqz", (12.7, 9.1, 8.2, 7.5, 7.0, 6.7, 6.3, 6.1, 6.0, 4.3, 4.0, 2.8, 2.8, 2.4, 2.4, 2.2, 2.0, 2.0, 1.9, 1.5, 1.0, 0.8, 0.15, 0.15, 0.1, 0.07), strict=True))
SMALL, CAPITAL, DIGIT, SIGN = 0.80, 0.10, 0.06, 0.04


def ordinary(alphabet: str) -> list[float]:
    """The share of each character of an alphabet in ordinary names that have no others."""
    share = [CAPITAL * LETTERS[c.lower()] / 100 if c.isupper() else SMALL * LETTERS[c] / 100 if c.islower() else DIGIT / 10 if c.isdigit() else SIGN / 4 for c in alphabet]
    if not any(c.islower() for c in alphabet):  # written in capitals
        share = [x * SMALL / CAPITAL if c.isupper() else x for c, x in zip(alphabet, share, strict=True)]
    return [x / sum(share) for x in share]


def weights(alphabet: str) -> tuple[list[float], float, float]:
    """For each character the log of its uniform share by its ordinary share; mean and standard deviation of that for ordinary characters."""
    q = ordinary(alphabet)
    w = [math.log(1 / len(q) / x) for x in q]
    mean = sum(x * y for x, y in zip(q, w, strict=True))
    return w, mean, math.sqrt(sum(x * (y - mean) ** 2 for x, y in zip(q, w, strict=True)))


def _unusual() -> str:
    """SQL: the p-value of token t (a lambda variable) under the hypothesis that it is ordinary."""
    numbers = lambda xs: "array(" + ", ".join(f"{x!r}D" for x in xs) + ")"
    cases = []
    for p, a in ENCODINGS:
        w, mean, sd = weights(a)
        cases.append(f"when t.token rlike '{p}' then named_struct('a', '{a}', 'w', {numbers(w)}, 'mean', {mean!r}D, 'sd', {sd!r}D)")
    said = f"transform(array(case {' '.join(cases)} end), e -> named_struct('e', e, 'c', split(regexp_replace(t.token, '=+$', ''), '')))[0]"
    z = f"transform(array({said}), x -> (aggregate(x.c, 0D, (s, c) -> s + x.e.w[instr(x.e.a, c) - 1]) - size(x.c) * x.e.mean) / (x.e.sd * sqrt(size(x.c))))[0]"
    return f"transform(array({z}), z -> case when z >= 0 then {_upper('z')} else 1D end)[0]"


def _found(text: Column, pattern: str, kind: str) -> Column:
    """array<struct<start, kind, end, token>> of all matches: the text between matches gives their places."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int,token:string>>")
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("hits"), F.split(text, pattern, -1).alias("gaps"))

    def fold(x: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.char_length(F.get(x["gaps"], i))
            hit = F.get(x["hits"], i)
            end = start + F.char_length(hit)
            one = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), hit.alias("token"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        def part(acc: Column, i: Column) -> Column:
            own = F.sequence(i, F.least(i + PART, F.size(x["hits"])) - 1)
            return F.aggregate(own, F.struct(acc["at"].alias("at"), none.alias("out")), step, lambda a: F.struct(a["at"].alias("at"), F.concat(acc["out"], a["out"]).alias("out")))

        first = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(x["hits"]) - 1, F.lit(PART)), first, part, lambda acc: acc["out"])

    # transform over a one-element array names hits and gaps, so that each is made once
    return F.when(text.rlike(pattern), F.transform(F.array(both), fold)[0]).otherwise(none)


def _upper(z: str) -> str:
    """SQL for the upper tail of the normal distribution at z >= 0 (rational approximation, error under 1e-7)."""
    t = f"(1 / (1 + 0.2316419 * ({z})))"
    poly = f"({t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    return f"(exp(-({z}) * ({z}) / 2) * 0.3989422804 * {poly})"


def _battery() -> str:
    """SQL: the combined p-value of token t (a lambda variable)."""
    alphabet = "case " + " ".join(f"when t.token rlike '{p}' then '{a}'" for p, a in ENCODINGS) + " end"
    # one-element arrays name the intermediate values
    values = f"transform(array({alphabet}), a -> struct(length(a) as k, transform(split(regexp_replace(t.token, '=+$', ''), ''), c -> instr(a, c) - 1) as v))[0]"
    named = f"transform(array({values}), x -> named_struct('k', least(x.k, 64), 'n', size(x.v), 'v', transform(x.v, c -> least(c, 63)), 'b', case when size(x.v) >= 80 then 16 when size(x.v) >= 40 then 8 else 4 end))[0]"
    chi = "aggregate(sequence(0, y.b - 1), 0D, (s, j) -> s + power(size(filter(y.v, c -> cast(floor(c * y.b / y.k) as int) = j)) - y.n / y.b, 2)) / (y.n / y.b)"
    ones = "size(filter(y.v, c -> 2 * c >= y.k))"
    runs = "1 + size(filter(sequence(1, y.n - 1), i -> (2 * y.v[i] >= y.k) <> (2 * y.v[i - 1] >= y.k)))"
    mean = "aggregate(y.v, 0D, (s, c) -> s + c) / y.n"
    stats = f"transform(array({named}), y -> named_struct('n', y.n, 'b', y.b, 'chi', {chi}, 'one', cast({ones} as double), 'runs', {runs}, 'mean', {mean}, 'v', y.v))[0]"
    var = "aggregate(q.v, 0D, (s, c) -> s + power(c - q.mean, 2))"
    lag = "aggregate(sequence(1, q.n - 1), 0D, (s, i) -> s + (q.v[i] - q.mean) * (q.v[i - 1] - q.mean))"
    expected = "(2 * q.one * (q.n - q.one) / q.n + 1)"
    spread = "(2 * q.one * (q.n - q.one) * (2 * q.one * (q.n - q.one) - q.n) / (q.n * q.n * (q.n - 1D)))"
    z_chi = "((power(q.chi / (q.b - 1), 1D / 3) - (1 - 2D / (9 * (q.b - 1)))) / sqrt(2D / (9 * (q.b - 1))))"
    zs = f"transform(array({stats}), q -> named_struct('chi', {z_chi}, 'runs', case when {spread} > 0 then abs(q.runs - {expected}) / sqrt({spread}) else 8D end, 'lag', case when {var} > 0 then abs({lag} / {var} + 1D / q.n) * sqrt(q.n) else 8D end))[0]"
    p_chi = f"case when z.chi >= 0 then {_upper('z.chi')} else 1 - {_upper('-z.chi')} end"
    ps = f"transform(array({zs}), z -> -ln(greatest({p_chi}, 1e-15D)) - ln(greatest(least(1D, 2 * {_upper('z.runs')}), 1e-15D)) - ln(greatest(least(1D, 2 * {_upper('z.lag')}), 1e-15D)))[0]"
    return f"transform(array({ps}), h -> exp(-h) * (1 + h + h * h / 2))[0]"  # chi-squared tail with 6 degrees of freedom


def spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with base (array of known shapes) and random (array of candidates with band and step) added."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    assign = F.filter(_found(t, ASSIGN, "assign"), lambda x: F.char_length(F.regexp_extract(x["token"], ASSIGN, 2)) >= 6)
    access = F.filter(_found(t, ACCESS, "access"), lambda x: F.char_length(x["token"]) >= 20)
    d = docs.withColumn("_base", F.array_sort(F.concat(assign, access, _found(t, HEX, "hex"))))
    d = d.withColumn("_tokens", _found(t, TOKEN, "random"))
    fits = lambda x: x["token"].rlike("[0-9]") & x["token"].rlike("[A-Za-z]") & ~F.exists("_base", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
    d = d.withColumn("_tokens", F.filter("_tokens", fits))
    band = "cast(floor(log2(length(t.token) / 20D)) as int)"
    step = f"cast(least({STEPS}, floor(-4 * log10(greatest({_unusual()}, 1e-15D)))) as int)"
    return d.withColumn("_random", F.expr(f"transform(_tokens, t -> named_struct('start', t.start, 'kind', t.kind, 'end', t.end, 'token', t.token, 'band', {band}, 'step', {step}, 'uniform', {_battery()} >= {LEVEL}D))")).drop("_tokens")


def rejected_from(found: DataFrame) -> dict[int, int]:
    """By length band, the step from which tokens aren't ordinary: Benjamini-Hochberg over all candidates."""
    rows = found.select(F.explode("_random").alias("r")).groupBy("r.band", "r.step").count().collect()  # bands x STEPS rows at most
    out = {}
    for band in {r.band for r in rows}:
        own = {r.step: r["count"] for r in rows if r.band == band}
        total, rank = sum(own.values()), 0
        for step in sorted(own, reverse=True):
            rank += own[step]
            if 10 ** (-step / 4) <= FDR * rank / total:
                out[band] = step
    return out


def _all_spans(limits: dict[int, int]) -> Column:
    cut = F.lit(STEPS + 1)
    keep = lambda x: x["uniform"] & (x["step"] >= (F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in limits.items() for v in kv]), x["band"]), cut) if limits else cut))
    plain = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["token"].alias("token"))
    return F.array_sort(F.concat("_base", F.transform(F.filter("_random", keep), plain)))


def _said(c: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    found = materialize(spans(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).drop("text"), "secret-spans")
    every = _all_spans(rejected_from(found))
    count = lambda k: F.size(F.filter("_base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_said(F.col("_base")), 256).alias("base_sha256"), _said(every).alias("spans"), (F.size(every) - F.size("_base")).cast("long").alias("n_random")
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with each run of overlapping spans in text replaced by mark, and n_chars (if there) counted anew."""
    limits = rejected_from(materialize(spans(docs.select(F.col("text").cast("string"))).select("_random"), "secret-tokens"))
    d = spans(docs).withColumn("_all", _all_spans(limits))
    step = lambda acc, x: F.when(
        x["start"] >= acc["at"], F.struct(F.concat(acc["out"], F.col("text").substr(acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark)).alias("out"), x["end"].alias("at"))
    ).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], x["end"]).alias("at")))
    clean = F.aggregate("_all", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.col("text").substr(acc["at"] + 1, F.char_length("text"))))
    d = d.withColumn("text", F.when(F.size("_all") > 0, clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(F.size("_all") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return d.select(*docs.columns)
