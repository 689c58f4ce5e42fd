"""Text functions: columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What Python's split() takes for white space.
SPACE = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
SNIPPET = 200

# Words that carry no meaning for retrieval.
STOPWORDS = (
    "a an the and or but if of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there"
    " when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now is are was were be been being have has"
    " had having do does did doing would could shall may might must i you he she it we they me him her us them my your his its our their this that these those what which who whom"
).split()


def normalize_whitespace(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(c, SPACE, " "))


def word_count(c: Column) -> Column:
    t = normalize_whitespace(c)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def quote(c: Column) -> Column:
    """The value in quotation marks, cut after 200 characters."""
    return F.concat(F.lit('"'), F.when(F.char_length(c) <= SNIPPET, c).otherwise(F.concat(F.substring(c, 1, SNIPPET), F.lit("..."))), F.lit('"'))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def tokenize(c: Column) -> Column:
    """Lower-case ASCII words without stopwords; a plural s is dropped from words over four letters."""
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0)
    kept = F.filter(words, lambda w: ~w.isin(STOPWORDS))
    return F.transform(kept, lambda w: F.when((F.char_length(w) > 4) & w.endswith("s") & ~w.endswith("ss"), w.substr(F.lit(1), F.char_length(w) - 1)).otherwise(w))


def coverage(query_tokens: Column, text_tokens: Column) -> Column:
    """The share of a query's distinct tokens that a text has; 0 for a query without any."""
    n = F.size(F.array_distinct(query_tokens))
    return F.when(n > 0, F.size(F.array_intersect(query_tokens, text_tokens)) / n).otherwise(F.lit(0.0))
