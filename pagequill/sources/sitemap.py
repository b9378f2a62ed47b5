"""Sitemaps and robots.txt, from a table of fetched files (url, body) or any fetch function."""

from __future__ import annotations

import gzip
import re
from collections.abc import Callable
from urllib.parse import urljoin, urlsplit
from urllib.robotparser import RobotFileParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
WELL_KNOWN = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemaps.xml")
MAX_DEPTH = 10


def parse_sitemap(body: bytes) -> tuple[list[str], list[str]]:
    """(page URLs, nested sitemaps) of one file, gzip or plain, any namespace; nothing if it is no XML."""
    if body[:2] == b"\x1f\x8b":
        try:
            body = gzip.decompress(body)
        except OSError:
            return [], []
    try:
        root = ElementTree.fromstring(body)
    except ElementTree.ParseError:
        return [], []
    name = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
    locs = {"url": [], "sitemap": []}
    for e in root:
        if name(e) in locs:
            locs[name(e)] += [c.text.strip() for c in e if name(c) == "loc" and c.text and c.text.strip()]
    return locs["url"], locs["sitemap"]


def robots_sitemaps(robots: str) -> list[str]:
    return [m.strip() for m in re.findall(r"(?im)^\s*sitemap:\s*(\S+)", robots or "")]


def discover_sitemaps(spark: SparkSession, base_url: str, fetch: Callable[[list[str]], DataFrame], robots: str = "") -> DataFrame:
    """(url, ord) of all sitemap entries, distinct, in the order first seen.

    fetch takes URLs and returns (url, body binary). Nested indexes are followed
    level by level; each level is parsed on the executors, and only the nested
    index URLs, of which a site has few, come to the driver.
    """
    todo = list(dict.fromkeys([*robots_sitemaps(robots), *(urljoin(base_url, p) for p in WELL_KNOWN)]))
    seen: set[str] = set()
    out = spark.createDataFrame([], "url string, ord long")

    @F.pandas_udf("pages array<string>, nested array<string>")
    def parsed(bodies: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_sitemap(bytes(b) if b is not None else b"") for b in bodies], columns=["pages", "nested"])

    for depth in range(MAX_DEPTH + 1):
        todo = [u for u in todo if u not in seen]
        if not todo:
            break
        seen.update(todo)
        place = spark.createDataFrame([(u, i) for i, u in enumerate(todo)], "url string, i long")
        rows = fetch(todo).join(F.broadcast(place), "url").select("i", parsed("body").alias("p")).select("i", "p.*").persist()
        pages = rows.select("i", F.posexplode("pages").alias("pos", "url"))
        out = out.unionByName(pages.select("url", (F.lit(depth) * (1 << 56) + F.col("i") * (1 << 32) + F.col("pos")).alias("ord")))
        todo = [u for r in rows.orderBy("i").select("nested").collect() for u in r[0]]
    return out.groupBy("url").agg(F.min("ord").alias("ord"))


def allowed_by_robots(urls: DataFrame, rules: DataFrame, agent: str = "*", url_col: str = "url") -> DataFrame:
    """urls with column allowed. rules: origin, status, body; one row per origin.

    401 and 403 disallow all; other errors, and origins without a row, allow all.
    Each origin's file is parsed once per batch.
    """
    origin = F.regexp_extract(url_col, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", 0)
    rows = urls.withColumn("__o", origin).join(rules.select(F.col("origin").alias("__o"), F.col("status").alias("__s"), F.col("body").alias("__b")), "__o", "left")

    @F.pandas_udf("boolean")
    def may(url: pd.Series, status: pd.Series, body: pd.Series) -> pd.Series:
        parsers: dict[str, RobotFileParser] = {}
        out = []
        for u, s, b in zip(url, status, body, strict=True):
            if pd.isna(s) or (s >= 400 and s not in (401, 403)):
                out.append(True)
            elif s in (401, 403):
                out.append(False)
            else:
                if b not in parsers:
                    parsers[b] = RobotFileParser()
                    parsers[b].parse((b or "").splitlines())
                out.append(parsers[b].can_fetch(agent, u))
        return pd.Series(out, dtype="bool")

    return rows.withColumn("allowed", may(url_col, "__s", "__b")).drop("__o", "__s", "__b")


def origin_of(url: str) -> str:
    p = urlsplit(url)
    return f"{p.scheme}://{p.netloc}"
