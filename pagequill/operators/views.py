"""Filters, facets and tables of the result views."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequill.functions.shared import materialize
from pagequill.sources.store import CrawlStore

TYPE_RANK = {"error": 0, "warning": 1, "info": 2}


def filter_links(links: DataFrame, internal: bool, text: str | None = None, status_class: int | None = None) -> DataFrame:
    """Internal or external links whose source, target and anchor (external: domain) hold the text, in any case."""
    rows = links.where(F.coalesce("is_internal", F.lit(False)) == internal)
    if status_class:
        rows = rows.where(F.floor(F.col("target_status") / 100) == status_class)
    if text:
        fields = ["source_url", "target_url", "anchor_text" if internal else "target_domain"]
        hit = F.lit(False)
        for f in fields:
            hit = hit | F.coalesce(F.lower(f).contains(text.lower()), F.lit(False))
        rows = rows.where(hit)
    return rows


def grouped_issues(issues: DataFrame, total_urls: int, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """(groups, rows): counts by issue, errors first, and at most `most` rows of each."""
    groups = issues.groupBy("issue").agg(F.min("type").alias("type"), F.min("category").alias("category"), F.count("*").alias("n"))
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in TYPE_RANK.items() for x in kv]), F.col("type"))
    groups = groups.withColumn("pct", F.round(100.0 * F.col("n") / max(total_urls, 1), 2)).orderBy(rank, F.desc("n"), "issue")
    w = Window.partitionBy("issue").orderBy("url", "details")
    rows = issues.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).drop("k")
    return groups, rows


def _kind(part: str) -> Column:
    return F.coalesce(F.lower("content_type").contains(part), F.lit(False))


URL_FILTERS = {
    "internal": lambda: F.coalesce("is_internal", F.lit(False)),
    "external": lambda: ~F.coalesce("is_internal", F.lit(False)),
    **{f"{k}xx": (lambda k=k: F.floor(F.col("status_code") / 100) == k) for k in (2, 3, 4, 5)},
    "no_response": lambda: (F.coalesce("status_code", F.lit(0)) == 0) & ~F.coalesce(F.col("error_type") == "file_too_large", F.lit(False)),
    "html": lambda: _kind("html"),
    "css": lambda: _kind("css"),
    "js": lambda: _kind("javascript"),
    "images": lambda: _kind("image"),
}


def filter_urls(pages: DataFrame, name: str) -> DataFrame:
    return pages.where(URL_FILTERS[name]())


def facets(pages: DataFrame) -> DataFrame:
    """One row of counts; a content type counts once, for the first that fits."""
    kinds = ("html", "css", "js", "images")
    first = F.lit("other")
    for k in reversed(kinds):
        first = F.when(URL_FILTERS[k](), k).otherwise(first)
    counts = [F.count_if(f()).alias(n) for n, f in URL_FILTERS.items() if n not in kinds]
    return pages.withColumn("__k", first).agg(*counts, *[F.count_if(F.col("__k") == k).alias(k) for k in kinds])


def status_table(pages: DataFrame) -> DataFrame:
    """(code, error_type, n, pct): HTTP codes by number, then fetch failures by kind."""
    code = F.coalesce("status_code", F.lit(0))
    kind = F.when(code == 0, F.coalesce("error_type", F.lit("unknown")))
    rows = pages.groupBy(code.alias("code"), kind.alias("error_type")).agg(F.count("*").alias("n"))
    total = F.broadcast(rows.agg(F.sum("n").alias("total")))  # one row
    return rows.join(total).select("code", "error_type", "n", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("pct")).orderBy(F.col("code") == 0, "code", F.desc("n"), "error_type")


def issue_types(issues: DataFrame) -> DataFrame:
    return issues.agg(*[F.count_if(F.col("type") == t).alias(f"{t}s") for t in TYPE_RANK])


def fetch_diagnostics(pages: DataFrame) -> DataFrame:
    """Counts by failure; refused and other connection errors share one."""
    e = F.col("error_type")
    return pages.agg(
        F.count_if(e == "dns_not_found").alias("dns_errors"), F.count_if(e == "ssl_error").alias("ssl_errors"), F.count_if(e == "timeout").alias("timeouts"),
        F.count_if(e.isin("connection_refused", "connection_error")).alias("connection_errors"), F.count_if(e == "file_too_large").alias("too_large"), F.count_if(e == "too_many_redirects").alias("redirect_errors"),
    )


def health(pages: DataFrame) -> DataFrame:
    return fetch_diagnostics(pages).withColumn("fetch_failures", F.col("dns_errors") + F.col("ssl_errors") + F.col("connection_errors"))


def discovery(discovered: DataFrame) -> DataFrame:
    """One row: discovered URLs, distinct normal forms, variants, URLs with a query."""
    from pagequill.functions.urls import is_parameterized, normalize_url

    rows = discovered.select("url", normalize_url(F.col("url"), True).alias("k"), is_parameterized(F.col("url")).alias("q"))
    return rows.agg(F.count("*").alias("discovered"), F.count_distinct("k").alias("distinct_urls"), (F.count("*") - F.count_distinct("k")).alias("duplicate_variants"), F.count_if("q").alias("parameterized"))


def progress(pages: DataFrame, discovered: int, seconds: float) -> DataFrame:
    n = F.count("*")
    return pages.agg(n.alias("crawled"), F.max("depth").alias("max_depth"), F.round(n / max(seconds, 1e-9), 2).alias("speed"), F.least(F.lit(100.0), 100.0 * n / max(discovered, 1)).alias("progress"))


def row_sizes(rows: DataFrame) -> DataFrame:
    """Rows and bytes of their JSON form, as an estimate of what they take."""
    return rows.select(F.octet_length(F.to_json(F.struct("*"))).alias("b")).agg(F.count("*").alias("n"), F.sum("b").alias("bytes"), F.round(F.avg("b"), 1).alias("mean_bytes"))


#: Seconds that a rating counts after it was asked for.
RATING_TTL = 300


def domain_ratings(requests: DataFrame, history: DataFrame, ttl: int = RATING_TTL) -> DataFrame:
    """requests (columns target, at) with domain, domain_rating (one decimal) and state, by the ratings known at that time.

    history has a row (domain, fetched_at, rating) for each answer. The last
    answer before the request counts for ttl seconds, or until the next one:
    state is then cached; else expired, missing (never asked) or invalid (no
    domain), and the rating is null. Answers hold in the one or two time slots
    of ttl seconds that they reach into, so that requests meet them by an equal
    (domain, slot) key, at most one each.
    """
    from pagequill.functions.urls import extract_domain

    seconds = lambda c: F.unix_micros(c) / 1_000_000
    known = history.groupBy("domain", "fetched_at").agg(F.round(F.max("rating"), 1).alias("domain_rating"))
    later = F.lead("fetched_at").over(Window.partitionBy("domain").orderBy("fetched_at"))
    known = known.withColumn("until", F.least(F.coalesce(seconds(later), F.lit(float("inf"))), seconds(F.col("fetched_at")) + ttl))
    slot = lambda s: F.floor(s / ttl)
    known = known.select(F.col("domain").alias("__d"), seconds(F.col("fetched_at")).alias("__from"), F.col("until").alias("__until"), "domain_rating")
    known = known.withColumn("__slot", F.explode(F.sequence(slot(F.col("__from")), slot(F.col("__until")))))
    first = history.groupBy(F.col("domain").alias("__f")).agg(F.min("fetched_at").alias("__first"))
    rows = requests.withColumn("domain", extract_domain(F.col("target"))).withColumn("__at", seconds(F.col("at")))
    here = (F.col("domain") == F.col("__d")) & (slot(F.col("__at")) == F.col("__slot")) & (F.col("__at") >= F.col("__from")) & (F.col("__at") < F.col("__until"))
    rows = rows.join(known, here, "left").join(first, F.col("domain") == F.col("__f"), "left")
    state = F.when(F.col("domain").isNull(), "invalid").when(F.col("__d").isNotNull(), "cached").when(F.col("__first") <= F.col("at"), "expired").otherwise("missing")
    return rows.withColumn("state", state).drop("__d", "__slot", "__from", "__until", "__f", "__first", "__at")


def look_up_ratings(targets: DataFrame, path: str, fetch: Callable[[DataFrame], DataFrame], now: datetime, ttl: int = RATING_TTL) -> DataFrame:
    """targets (column target) with domain, domain_rating and cached, by a table of answers at path that lasts.

    Distinct domains that the table has no valid answer for are asked, by fetch:
    domains (column domain) to (domain, rating), rating null if that failed.
    Answers are appended to the table; a failure is asked for again next time.
    """
    spark = targets.sparkSession
    kept = CrawlStore(spark, path)
    none = spark.createDataFrame([], "domain string, fetched_at timestamp, rating double")
    history = spark.read.schema(none.schema).parquet(path) if kept.has(path) else none
    at = F.lit(now).cast("timestamp")
    asked = domain_ratings(targets.withColumn("at", at), history, ttl)
    open_domains = asked.where(F.col("state").isin("expired", "missing")).select("domain").distinct()
    got = materialize(fetch(open_domains).where(F.col("rating").isNotNull()).select("domain", at.alias("fetched_at"), F.col("rating").cast("double").alias("rating")), "ratings")
    rows = materialize(asked, "rated")
    got.write.mode("append").parquet(path)
    new = got.groupBy("domain").agg(F.round(F.max("rating"), 1).alias("__new"))
    rows = rows.join(new, "domain", "left").withColumn("domain_rating", F.coalesce("domain_rating", "__new"))
    return rows.select(*targets.columns, "domain", "domain_rating", (F.col("state") == "cached").alias("cached"))
