"""The crawl summary: groups, graph, clusters, score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequill.functions.scalars import status_bucket
from pagequill.functions.shared import materialize
from pagequill.operators import clusters, linkgraph, prioritize

#: Fixed penalties of a group, by severity.
PENALTY = {"critical": 10.0, "high": 5.0, "medium": 2.0, "low": 0.5}


@dataclass
class CrawlSummary:
    totals: DataFrame
    groups: DataFrame
    metrics: DataFrame
    clusters: DataFrame
    status_breakdown: DataFrame
    broken: DataFrame
    redirected: DataFrame


def status_breakdown(pages: DataFrame) -> DataFrame:
    return pages.groupBy(status_bucket(F.col("status_code")).alias("bucket")).agg(F.count("*").alias("n"))


def severity_counts(groups: DataFrame) -> DataFrame:
    return groups.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in PENALTY])


def site_score(groups: DataFrame, metrics: DataFrame, links: DataFrame) -> DataFrame:
    """One row: 100 less penalties for groups, orphans and broken links, not under 0."""
    points = F.create_map(*[F.lit(x) for kv in PENALTY.items() for x in kv])
    a = groups.agg(F.coalesce(F.sum(F.element_at(points, F.col("severity"))), F.lit(0.0)).alias("penalty"))
    b = metrics.agg(F.count_if("is_orphan").alias("orphans"))
    c = linkgraph.broken_links(links).agg(F.count("*").alias("broken"))
    row = a.join(F.broadcast(b)).join(F.broadcast(c))  # one row each
    score = 100 - F.col("penalty") - F.least(F.lit(10.0), F.col("orphans").cast("double")) - F.least(F.lit(10.0), 0.5 * F.col("broken"))
    return row.select(F.greatest(F.lit(0.0), F.round(score, 1)).alias("site_score"), F.col("orphans").alias("orphan_count"), F.col("broken").alias("broken_link_count"))


def page_totals(pages: DataFrame) -> DataFrame:
    inside = F.coalesce("is_internal", F.lit(True))
    return pages.agg(F.count("*").alias("total_pages"), F.count_if(inside).alias("internal_pages"), F.coalesce(F.round(F.avg(F.when(inside, F.coalesce("depth", F.lit(0)))), 1), F.lit(0.0)).alias("avg_depth"))


def summarize_crawl(pages: DataFrame, links: DataFrame, issues: DataFrame, each_page: bool = False) -> CrawlSummary:
    """All parts of the summary; empty inputs give empty parts and a score of 100. each_page: as in group_issues."""
    groups = materialize(prioritize.group_issues(issues, pages, each_page=each_page), "issue-groups")
    graph = linkgraph.site_graph(pages, links)
    metrics = materialize(linkgraph.page_metrics(*graph), "page-metrics")
    totals = page_totals(pages).join(F.broadcast(severity_counts(groups))).join(F.broadcast(site_score(groups, metrics, links)))
    found = clusters.detect_clusters(pages, graph[1], metrics)
    order = [F.desc("priority_score"), F.desc("affected_url_count"), "issue"]
    return CrawlSummary(totals, groups.orderBy(*order), metrics, found, status_breakdown(pages), linkgraph.broken_links(links), linkgraph.redirected_links(links))
