"""Fetching pages over HTTP on the executors, and the crawl loop over frontier tables."""

from __future__ import annotations

import math
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequill.functions.scalars import fetch_error
from pagequill.functions.shared import materialize, new_path, numbered, without
from pagequill.operators.filters import CrawlScope
from pagequill.operators.linkgraph import first_images
from pagequill.sources import html as html_source
from pagequill.sources.store import CrawlStore

RESPONSE = "url string, depth int, status_code int, content_type string, size long, html string, redirects array<struct<url:string,status_code:int>>, final_url string, response_time double, error string, ord long"


@dataclass(frozen=True)
class FetchSettings:
    timeout: float = 10.0
    retries: int = 3
    pause: float = 1.0
    delay: float = 0.0
    max_bytes: int = 50 << 20
    headers: dict = field(default_factory=lambda: {"User-Agent": "pagequill/0.1"})


class _Hops(urllib.request.HTTPRedirectHandler):
    def __init__(self) -> None:
        self.hops: list[dict] = []

    def redirect_request(self, req, fp, code, msg, headers, newurl):  # noqa: ANN001, ANN201
        self.hops.append({"url": req.full_url, "status_code": code})
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def fetch_one(url: str, depth: int, s: FetchSettings) -> dict:
    """One URL: a HEAD that gates on size, then GET with retries. A failure is a row with status 0 and a message."""
    row = {"url": url, "depth": depth, "status_code": 0, "content_type": "", "size": 0, "html": "", "redirects": [], "final_url": "", "error": "", "response_time": 0.0}
    began = time.monotonic()
    for turn in range(s.retries + 1):
        hops = _Hops()
        opener = urllib.request.build_opener(hops)
        try:
            if not turn:
                try:
                    head = opener.open(urllib.request.Request(url, headers=s.headers, method="HEAD"), timeout=s.timeout)
                    if int(head.headers.get("Content-Length") or 0) > s.max_bytes:
                        return row | {"error": "file_too_large"}
                except (OSError, ValueError):
                    pass
                hops.hops.clear()
            try:
                got = opener.open(urllib.request.Request(url, headers=s.headers), timeout=s.timeout)
            except urllib.error.HTTPError as e:
                got = e
            body = got.read(s.max_bytes + 1)
            if len(body) > s.max_bytes:
                return row | {"error": "file_too_large"}
            kind = (got.headers.get("Content-Type") or "").split(";")[0]
            text = body.decode(got.headers.get_content_charset() or "utf-8", "replace") if "text/html" in kind else ""
            return row | {"status_code": got.status, "content_type": kind, "size": len(body), "html": text, "redirects": hops.hops, "final_url": got.url, "response_time": round((time.monotonic() - began) * 1000, 2)}
        except (OSError, ValueError) as e:
            row["error"] = str(e)
            if turn < s.retries:
                time.sleep(s.pause)
    return row | {"response_time": round((time.monotonic() - began) * 1000, 2)}


#: Tasks that the URLs of a host are dealt to where a delay is asked for.
LANES = 8


def next_turn(now: float, lane: int, lanes: int, delay: float) -> float:
    """The next time at which a lane may ask its host: lanes take turns on one clock, `delay` seconds each.

    Whichever lanes run, and however late, two requests to a host are at least a
    delay apart, as each lane has its own points in time.
    """
    period = lanes * delay
    turn = lane * delay + max(math.ceil((now - lane * delay) / period), 0) * period
    return turn if turn >= now else turn + period


def _tasks(rows: DataFrame) -> int:
    """Tasks to spread requests over, told as a number: adaptive execution would put a few kilobytes of URLs into one."""
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def http_fetch(frontier: DataFrame, settings: FetchSettings | None = None, lanes: int = LANES) -> DataFrame:
    """Responses for (url, depth, ord). All URLs are spread over tasks; with a delay a host's are dealt to `lanes` lanes, which take turns.

    A lane is one key of the shuffle and has its own points in time (next_turn),
    so a host that has most URLs is fetched by several tasks at its full rate. A
    task mixes the lanes it has, and while one lane waits, that is all it does.
    """
    s = settings or FetchSettings()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked: dict[tuple, float] = {}
        for part in parts:
            for u, d, k, lane in zip(part.url, part.depth, part.ord, part.lane, strict=True):
                if s.delay:
                    host = urlsplit(u).netloc
                    now = time.time()
                    turn = next_turn(max(now, asked.get((host, lane), 0.0) + s.delay / 2), int(lane), lanes, s.delay)
                    time.sleep(max(turn - now, 0.0))
                    asked[host, lane] = turn
                yield pd.DataFrame([fetch_one(u, int(d), s) | {"ord": k}])

    host = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    rows = frontier.select("url", "depth", "ord", F.pmod(F.xxhash64("url"), F.lit(lanes)).alias("lane"))
    parts = _tasks(frontier)
    dealt = rows.repartition(parts, host, "lane").sortWithinPartitions(F.xxhash64("url")) if s.delay else rows.repartition(parts, "url")
    return dealt.mapInPandas(run, RESPONSE)


def head_status(url: str, timeout: float = 5.0, headers: dict | None = None) -> int:
    """The status of a HEAD request, redirects followed; 0 if there is no answer."""
    try:
        return urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}, method="HEAD"), timeout=timeout).status
    except urllib.error.HTTPError as e:
        return e.code
    except (OSError, ValueError):
        return 0


#: HEAD requests that a task has under way at once.
AT_ONCE = 5


def http_probe(urls: DataFrame, at_once: int = AT_ONCE, ask: Callable[[str], int] = head_status) -> DataFrame:
    """(src, status) of distinct URLs (column src), spread over tasks; a task has at_once requests under way."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for part in parts:
                yield pd.DataFrame({"src": part.src, "status": pd.Series(list(pool.map(ask, part.src)), part.index, dtype="int32")})

    return urls.select("src").repartition(_tasks(urls), "src").mapInPandas(run, "src string, status int")


def image_statuses(images: DataFrame, path: str, probe: Callable[[DataFrame], DataFrame] = http_probe, most: int = 50) -> DataFrame:
    """(src, status) of the images (url, pos, src) of pages, by a table of answers at path that lasts from crawl to crawl.

    Distinct URLs that the table does not have are probed, once, and their answers
    appended; of a page's images without an answer the first `most` are asked for,
    and the others stay without a status until a later crawl asks for them.
    """
    spark = images.sparkSession
    kept = CrawlStore(spark, path)
    schema = "src string, status int"
    known = spark.read.schema(schema).parquet(path) if kept.has(path) else spark.createDataFrame([], schema)
    rows = images.where(F.col("src").rlike("^https?:")).select("url", "pos", "src")
    fresh = first_images(without(rows, "src", known), most).select("src").distinct()
    materialize(probe(fresh).select("src", F.col("status").cast("int").alias("status")), "probed").write.mode("append").parquet(path)
    return rows.select("src").distinct().join(spark.read.schema(schema).parquet(path), "src")


def table_fetch(pages: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A fetch that answers from a stored table (url, html, optionally status_code); unknown URLs are 404."""
    code = F.coalesce("status_code", F.lit(200)) if "status_code" in pages.columns else F.lit(200)
    known = pages.select(F.col("url"), "html", code.cast("int").alias("__s"))

    def fetch(frontier: DataFrame) -> DataFrame:
        rows = frontier.join(known, "url", "left")
        return rows.select(
            "url", "depth", F.coalesce("__s", F.lit(404)).alias("status_code"), F.lit("text/html").alias("content_type"), F.coalesce(F.octet_length("html"), F.lit(0)).cast("long").alias("size"),
            F.coalesce("html", F.lit("")).alias("html"), F.array().cast("array<struct<url:string,status_code:int>>").alias("redirects"), F.col("url").alias("final_url"), F.lit(0.0).alias("response_time"), F.lit("").alias("error"), "ord",
        )

    return fetch


def _done(spark: SparkSession, path: str, marker: str) -> list[int]:
    """The numbers 0, 1, ... of the folders under path that have a finished <marker> (the folder itself if that is empty)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: list[int] = []
    while fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{len(found)}/{marker}/_SUCCESS".replace("//_", "/_"))):
        found.append(len(found))
    return found


def crawl(seeds: DataFrame, scope: CrawlScope, fetch: Callable[[DataFrame], DataFrame], max_urls: int | None = None, state: str | None = None, stop: Callable[[], bool] | None = None, part_urls: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages, links): breadth-first, one level of the frontier at a time.

    A level is fetched and parsed on the executors and written; the next one is
    the accepted targets, distinct, less what is seen: plans don't grow with the
    number of levels. ord numbers pages by (level, URL). With part_urls a level is
    fetched in parts of so many URLs, in that order.

    With state, a folder, each part's pages and each level's links and next
    frontier are written there, the frontier last: a crawl that is started again
    with the same folder goes on after the last whole part. stop is asked before
    each part but the first, and pauses the crawl: pages then has what has been
    fetched, links what the whole levels link to, and the rest of the queue stays
    in the folder.
    """
    spark = seeds.sparkSession
    root = state or new_path(spark, "crawl")
    read = lambda part, *levels: spark.read.parquet(*[f"{root}/{k}/{part}" for k in levels])
    parts_of = lambda level: [f"{root}/{level}/pages/{j}" for j in _done(spark, f"{root}/{level}/pages", "")]
    done = _done(spark, root, "frontier") if state else []
    pages_at = [p for k in done for p in parts_of(k)]
    total = spark.read.parquet(*pages_at).count() if done else 0
    if not done and not (state and CrawlStore(spark, root).has(f"{root}/seeds/_SUCCESS")):
        numbered(seeds.select("url", F.lit(0).alias("depth")).distinct(), ["url"], "seeds").write.mode("overwrite").parquet(f"{root}/seeds")
    frontier = read("frontier", done[-1]) if done else spark.read.parquet(f"{root}/seeds")
    asked = False
    for depth in range(len(done), scope.max_depth + 1):
        if depth > 0 and (frontier.isEmpty() or (max_urls is not None and total >= max_urls) or (asked and stop is not None and stop())):
            break
        if max_urls is not None:
            frontier = frontier.orderBy("ord").limit(max(max_urls - total, 0))
        first, last = frontier.agg(F.min("ord"), F.max("ord")).first()
        size = part_urls or (last - first + 1 if last is not None else 1)
        own = parts_of(depth) if state else []
        for j in range(len(own), max(-(-(last - first + 1) // size), 1) if last is not None else 1):
            if asked and j and stop is not None and stop():
                break
            asked = True
            part = frontier.where(F.col("ord").between(first + j * size, first + (j + 1) * size - 1)) if last is not None else frontier
            got = fetch(part).withColumn("error_type", F.when(F.col("error") == "file_too_large", "file_too_large").when(F.col("status_code") == 0, fetch_error(F.col("error"))))
            own.append(f"{root}/{depth}/pages/{j}")
            html_source.extract_pages(got).write.mode("overwrite").parquet(own[-1])
        pages_at += own
        if last is not None and len(own) * size < last - first + 1:
            break  # paused within the level
        got = spark.read.parquet(*own)
        total += got.count()
        html_source.collect_links(got).write.mode("overwrite").parquet(f"{root}/{depth}/links")
        found = read("links", depth)
        new = found.where((F.col("placement") != "image") & scope.accepts(F.col("target_url"))).select(F.regexp_replace("target_url", "#.*$", "").alias("url")).distinct()
        # What is seen is one scan of the folders so far, and a mark table leaves few of its rows to be joined.
        seen = spark.read.parquet(f"{root}/seeds", *[f"{root}/{k}/frontier" for k in done]).select("url")
        new = numbered(without(new, "url", seen).withColumn("depth", F.lit(depth + 1)), ["url"], f"frontier-{depth}", total)
        new.write.mode("overwrite").parquet(f"{root}/{depth}/frontier")
        frontier = read("frontier", depth)
        done.append(depth)
    pages = spark.read.parquet(*pages_at).drop("links")
    return pages, (read("links", *done) if done else html_source.collect_links(spark.read.parquet(*pages_at)).limit(0))
