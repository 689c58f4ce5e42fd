"""Phones, addresses and names: comparison forms and shape gates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.text import normalize_whitespace

# Address words and legal suffixes.
STREETS = {"st": "street", "str": "street", "rd": "road", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "bvd": "boulevard", "dr": "drive", "ln": "lane", "ct": "court", "pl": "place", "sq": "square", "ter": "terrace", "pkwy": "parkway", "hwy": "highway", "cres": "crescent", "cl": "close", "gdns": "gardens"}
DIRECTIONS = {"n": "north", "s": "south", "e": "east", "w": "west", "ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest"}
UNITS = {"ste": "suite", "apt": "apartment", "bldg": "building", "fl": "floor", "flr": "floor", "rm": "room", "dept": "department", "unit": "unit"}
LEGAL_SUFFIXES = "inc incorporated llc llp lp ltd limited plc pvt private corp corporation co company gmbh bv nv ag sa srl pty pte".split()
RIGHTS_WORDS = "all some no rights reserved worldwide globally international".split()
PHONE = r"(?U)\+?\d[\d\s().\-]{6,20}\d"
ADDRESS = (
    r"(?iU)\b\d{2,6}[a-zA-Z]?\s+(?:[A-Za-z0-9.'\-]+\s+){0,3}(?:street|st|road|rd|avenue|ave|boulevard|blvd|drive|dr|lane|ln|court|ct|"
    r"place|pl|square|sq|terrace|ter|parkway|pkwy|highway|hwy|way|close|cl|crescent|cres|gardens|gdns)\b"
)
COPYRIGHT = r"(?U)(?:©\s*(?:\d{4}\s*(?:[-–]\s*\d{4})?\s*)?|(?i:copyright|\(c\))\s+\d{4}\s*(?:[-–]\s*\d{4})?\s*)(?:(?i:by)\s+)?([A-Z][\w&'’\-]*(?:\s+[A-Z][\w&'’\-]*){0,5})"


def _lookup(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def normalize_phone(c: Column) -> Column:
    """The last ten digits, or '' for fewer than 7 or more than 15."""
    digits = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\D+", "")
    return F.when(F.char_length(digits).between(7, 15), F.right(digits, F.lit(10))).otherwise(F.lit(""))


def _plain_words(c: Column) -> Column:
    return F.filter(F.split(normalize_whitespace(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]+", " ")), " "), lambda w: w != "")


def normalize_address(c: Column) -> Column:
    """Abbreviations written out: directions and units anywhere, street words only after a word with a digit."""
    words = _plain_words(F.coalesce(c, F.lit("")))
    always, streets = _lookup(DIRECTIONS | UNITS), _lookup(STREETS)

    def step(acc: Column, w: Column) -> Column:
        digit = w.rlike(r"[\p{Nd}\x{b2}\x{b3}\x{b9}\x{2070}-\x{2079}\x{2080}-\x{2089}]")
        out = F.when(digit, w).otherwise(F.coalesce(F.element_at(always, w), F.when(acc["seen"], F.element_at(streets, w)), w))
        return F.struct(F.concat(acc["out"], F.array(out)).alias("out"), (acc["seen"] | digit).alias("seen"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("seen"))
    return F.aggregate(words, start, step, lambda acc: F.array_join(acc["out"], " "))


def normalize_name(c: Column) -> Column:
    return F.array_join(_plain_words(F.regexp_replace(F.coalesce(c, F.lit("")), "['’]", "")), " ")


def strip_legal_suffix(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, r"(?:(?:^| )(?:" + "|".join(LEGAL_SUFFIXES) + r"))+$", ""))


def differs_only_by_legal_suffix(a: Column, b: Column) -> Column:
    return (a != b) & (strip_legal_suffix(a) == strip_legal_suffix(b)) & (strip_legal_suffix(a) != "")


def address_subsumes(longer: Column, shorter: Column) -> Column:
    """Whether an address begins with all words of a shorter one and adds no unit."""
    rest = F.split(F.substr(longer, F.char_length(shorter) + 2), " ")
    units = F.array(*[F.lit(u) for u in sorted(set(UNITS.values()))])
    return (shorter != "") & longer.startswith(F.concat(shorter, F.lit(" "))) & ~F.arrays_overlap(rest, units)


def is_phone_shaped(c: Column) -> Column:
    t = F.btrim(c)
    groups = F.regexp_extract_all(c, F.lit(r"(?U)\d+"), 0)
    of = lambda n: F.size(F.filter(groups, lambda g: F.char_length(g) == n))
    plus = t.startswith("+")
    return (
        c.rlike(r"[()\-.]|^\+")
        & ~t.rlike(r"(?U)^\d{4}\s*-\s*\d{2}\s*-\s*\d{2}$")
        & ((F.size(groups) >= 2) | plus)
        & ((of(4) < 2) | c.contains("(") | plus)
        & (of(1) <= 1)
    )


def is_address_shaped(c: Column) -> Column:
    """Not led by a number that reads as a year."""
    return ~F.btrim(c).rlike(r"(?U)^(?:19|20)\d{2}(?!\d)")


def is_rights_text(c: Column) -> Column:
    words = F.filter(F.split(normalize_whitespace(F.lower(c)), " "), lambda w: w != "")
    return (F.size(words) > 0) & F.forall(words, lambda w: w.isin(RIGHTS_WORDS))


def phones(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(PHONE), 0), is_phone_shaped)


def addresses(text: Column, years: bool = False) -> Column:
    """Addresses of a text; those led by what reads as a year only with years, for texts in which such a number is known to be a house's."""
    every = F.regexp_extract_all(text, F.lit(ADDRESS), 0)
    return every if years else F.filter(every, is_address_shaped)


def copyright_names(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(COPYRIGHT), 1), lambda c: ~is_rights_text(c))
