"""Path clusters and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequill.functions.urls import cluster_id
from pagequill.operators.linkgraph import internal_links, internal_pages

WEAK_SHARE, WEAK_MOST, EXAMPLES = 0.2, 10, 5


def cross_links(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(cluster_id, total_out, cross_out, cross_cluster_link_share) of body links between known pages."""
    of = internal_pages(pages).select("norm", cluster_id(F.col("norm")).alias("c"))
    rows = internal_links(links).where("placement = 'body'")
    rows = rows.join(of.select(F.col("norm").alias("s"), F.col("c").alias("cs")), "s").join(of.select(F.col("norm").alias("t"), F.col("c").alias("ct")), "t")
    out = rows.groupBy(F.col("cs").alias("cluster_id")).agg(F.count("*").alias("total_out"), F.count_if(F.col("cs") != F.col("ct")).alias("cross_out"))
    return out.withColumn("cross_cluster_link_share", F.round(F.col("cross_out") / F.col("total_out"), 3))


def detect_clusters(pages: DataFrame, links: DataFrame | None = None, metrics: DataFrame | None = None) -> DataFrame:
    """A row per cluster, largest first: size, examples, authority statistics, orphans, share of links that leave.

    Sizes are counted before the shuffle; the example URLs and weak pages are
    ranked lists cut to a few per task and cluster before they are merged.
    """
    from pagequill.functions.urls import normalize_url

    rows = pages.where(F.coalesce("is_internal", F.lit(True))).select("ord", "url", cluster_id(normalize_url(F.col("url"), True)).alias("cluster_id"))
    # A rank limit is applied in each task before rows are shuffled, so a large cluster sends a few of them.
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy("ord", "url"))
    shown = rows.select("cluster_id", "ord", "url", place.alias("k")).where(F.col("k") <= EXAMPLES)
    shown = shown.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "url"))), lambda e: e["url"]).alias("example_urls"))
    out = rows.groupBy("cluster_id").agg(F.count("*").alias("size")).join(shown, "cluster_id")
    if metrics is not None:
        m = metrics.withColumn("cluster_id", cluster_id(F.col("norm")))
        best = F.max(F.struct(F.col("authority_score"), (-F.col("ord")).alias("o"), F.col("url"))).alias("top")
        stats = m.groupBy("cluster_id").agg(best, F.round(F.avg("authority_score"), 1).alias("avg_authority"), F.count_if("is_orphan").alias("orphan_count"))
        bar = stats.select("cluster_id", (F.col("top.authority_score") * WEAK_SHARE).alias("bar"), (-F.col("top.o")).alias("top_ord"))
        weak = m.join(bar, "cluster_id").where("authority_score < bar and ord <> top_ord")
        w = Window.partitionBy("cluster_id").orderBy(F.desc("authority_score"), "ord")
        weak = weak.withColumn("k", F.row_number().over(w)).where(F.col("k") <= WEAK_MOST).groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "url"))), lambda e: e["url"]).alias("weak_pages"))
        stats = stats.select("cluster_id", F.col("top.url").alias("top_url"), F.col("top.authority_score").alias("top_authority"), "avg_authority", "orphan_count")
        out = out.join(stats, "cluster_id", "left").join(weak, "cluster_id", "left")
    if links is not None:
        out = out.join(cross_links(pages, links).select("cluster_id", "cross_cluster_link_share"), "cluster_id", "left")
    return out.withColumn("name", F.when(F.col("cluster_id") == "/", "Root pages").otherwise(F.trim(F.lit("/"), F.col("cluster_id")))).orderBy(F.desc("size"), "cluster_id")
