"""URL functions. Anything that is not a usable http(s) URL is null."""

from __future__ import annotations

from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Query keys that only track.
TRACKING = frozenset(
    "utm_source utm_medium utm_campaign utm_term utm_content utm_id utm_source_platform gclid gclsrc dclid fbclid msclkid twclid igshid mc_cid mc_eid _ga _gl yclid hsa_cam hsa_grp hsa_ad".split()
)
PORTS = {"http": 80, "https": 443}
# Path segments of legal documents.
LEGAL = ["legal", "terms", "tos", "privacy", "cookie-policy", "cookies", "gdpr", "dpa", "acceptable-use", "eula"]


def canonical_form(raw: str | None, base: str | None = None) -> str | None:
    """The crawl form of a URL: host and scheme in lower case, no default port, user, fragment or tracking keys, query sorted."""
    if raw is None or not raw.strip():
        return None
    try:
        u = urlsplit(urljoin(base, raw.strip()) if base else raw.strip())
        scheme, host, port = u.scheme.lower(), u.hostname, u.port
    except ValueError:
        return None
    if scheme not in PORTS or not host:
        return None
    host = f"[{host}]" if ":" in host else host
    place = host if port in (None, PORTS[scheme]) else f"{host}:{port}"
    pairs = sorted(p for p in parse_qsl(u.query, keep_blank_values=True) if p[0].lower() not in TRACKING)
    return urlunsplit((scheme, place, u.path or "/", urlencode(pairs), ""))


@F.pandas_udf(StringType())
def normalize_url(raw: pd.Series) -> pd.Series:
    return pd.Series([canonical_form(r) for r in raw], dtype=object)


@F.pandas_udf(StringType())
def resolve_url(raw: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([canonical_form(r, b) for r, b in zip(raw, base, strict=True)], dtype=object)


def host_of(url: Column) -> Column:
    """Host of an http(s) URL or bare host, in lower case without one leading www."""
    whole = F.lower(F.btrim(url))
    web = F.regexp_extract(whole, r"^https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    bare = F.when(whole.rlike(r"^[a-z][a-z0-9+.-]*:(?!\d)"), F.lit("")).otherwise(F.regexp_extract(whole, r"^(?://)?([^/?#:]*)", 1))
    return F.regexp_replace(F.when(whole.rlike("^https?://"), web).otherwise(bare), r"^www\.", "")


def is_same_domain(url: Column, base: Column, include_subdomains: bool = False) -> Column:
    a, b = host_of(url), host_of(base)
    same = a == b
    if include_subdomains:
        same = same | a.endswith(F.concat(F.lit("."), b))
    return F.coalesce((a != "") & (b != "") & same, F.lit(False))


def dedup_key(normalized: Column) -> Column:
    """Of a normalized URL: without scheme, leading www. and the slashes that end a path."""
    rest = F.regexp_replace(F.regexp_replace(normalized, r"^https?://", ""), r"^www\.", "")
    path = F.regexp_extract(rest, r"^([^?]*)", 1)
    query = F.regexp_extract(rest, r"(\?.*)$", 1)
    root = path.rlike(r"^[^/]*/$")
    return F.concat(F.when(root, path).otherwise(F.regexp_replace(path, "/+$", "")), query)


def link_key(url: Column) -> Column:
    cut = F.regexp_replace(url, "/+$", "")
    return F.when(cut == "", url).otherwise(cut)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def is_root_path(url: Column) -> Column:
    return path_of(url).isin("", "/")


def is_legal_document(url: Column) -> Column:
    segments = F.split(F.btrim(F.lower(path_of(url)), F.lit("/")), "/")
    return F.exists(segments, lambda s: s.rlike("^(?:" + "|".join(LEGAL) + ")(?:-.*)?$"))


def robots_url(url: Column) -> Column:
    return F.concat(F.regexp_extract(url, r"^(https?://[^/?#]*)", 1), F.lit("/robots.txt"))
