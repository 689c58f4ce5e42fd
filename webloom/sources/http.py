"""Fetching over HTTP: fetched() for tables of addresses (the crawl's way), and a source for a given list of addresses, spark.read.format("webfetch").option("urls", "...").load(), which is off unless registered."""

from __future__ import annotations

import time
import urllib.error
import urllib.request

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from webloom.functions import urls as U

SCHEMA = "url string, final_url string, status_code int, html string, content_type string, x_robots_tag array<string>, redirect_chain array<string>, error string"
RETRY = {429, 500, 502, 503, 504}


def http_get(url: str, agent: str, timeout: float) -> tuple:
    """(final_url, status, headers, body, chain)."""
    chain: list[str] = []

    class Noting(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, req, fp, code, msg, headers, newurl):
            chain.append(req.full_url)
            return super().redirect_request(req, fp, code, msg, headers, newurl)

    opener = urllib.request.build_opener(Noting())
    try:
        with opener.open(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=timeout) as r:
            return r.url, r.status, r.headers, r.read(), chain
    except urllib.error.HTTPError as e:
        return e.url or url, e.code, e.headers, e.read(), chain


def fetch(url: str, agent: str = "webloom", timeout: float = 10, attempts: int = 3, get=http_get, pause=time.sleep) -> tuple:
    """A row of SCHEMA; transport errors and RETRY statuses are tried again, attempts times in all."""
    error = None
    for n in range(attempts):
        if n:
            pause(0.5 * 2 ** (n - 1))
        try:
            final, status, headers, body, chain = get(url, agent, timeout)
        except Exception as e:  # noqa: BLE001
            error = f"{type(e).__name__}: {e}"
            continue
        if status in RETRY and n + 1 < attempts:
            continue
        kind = (headers.get("Content-Type") or "").split(";")[0].strip().lower() or None
        shown = not kind or kind.startswith(("text/html", "application/xhtml+xml"))
        tags = headers.get_all("X-Robots-Tag") if hasattr(headers, "get_all") else [headers["X-Robots-Tag"]] if "X-Robots-Tag" in headers else []
        return url, final, int(status), body.decode("utf-8", "replace") if shown else "", kind, list(tags or []), chain, None
    return url, url, 0, "", None, [], [], error


def fetch_bytes(url: str, agent: str = "webloom", timeout: float = 10, attempts: int = 3, get=http_get, pause=time.sleep) -> tuple:
    """(url, status_code, body); the status is null if no attempt got an answer."""
    status = body = None
    for n in range(attempts):
        if n:
            pause(0.5 * 2 ** (n - 1))
        try:
            _, status, _, body, _ = get(url, agent, timeout)
        except Exception:  # noqa: BLE001
            continue
        if status not in RETRY:
            break
    return url, status, body


def fetched(urls: DataFrame, raw: bool = False, delay: float = 0.2, agent: str = "webloom", timeout: float = 10, attempts: int = 3, get=http_get, pause=time.sleep) -> DataFrame:
    """Rows of SCHEMA for urls(url, and delay if hosts ask for more); with raw: url, status_code, body. A host's addresses stand in one task, which waits between them. The result fetches each time it is computed, so write it before it is used twice."""
    urls = urls.select("url", (F.greatest(F.lit(delay), F.col("delay")) if "delay" in urls.columns else F.lit(delay)).alias("delay"), U.host_of(F.col("url")).alias("host"))
    one = fetch_bytes if raw else fetch
    schema = "url string, status_code int, body binary" if raw else SCHEMA
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames):
        last = None
        for f in frames:
            rows = []
            for r in f.itertuples():
                if r.host == last:
                    pause(r.delay)
                last = r.host
                rows.append(one(r.url, agent, timeout, attempts, get, pause))
            yield pd.DataFrame(rows, columns=names).astype({"status_code": "Int32"})

    return urls.repartition("host").sortWithinPartitions("host", "url").mapInPandas(run, schema)


class WebFetch(DataSource):
    @classmethod
    def name(cls):
        return "webfetch"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.urls = [u for u in options.get("urls", "").split() if u]
        self.delay, self.timeout, self.agent = float(options.get("delay", 0.2)), float(options.get("timeout", 10)), options.get("agent", "webloom")

    def partitions(self):
        """One for each host, so that a host is asked by one task at a time."""
        hosts: dict[str, list[str]] = {}
        for u in self.urls:
            hosts.setdefault(u.split("/")[2] if "//" in u else u, []).append(u)
        return [InputPartition(v) for v in hosts.values()] or [InputPartition([])]

    def read(self, partition):
        for i, u in enumerate(partition.value):
            if i:
                time.sleep(self.delay)
            yield fetch(u, self.agent, self.timeout)
