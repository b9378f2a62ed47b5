"""Crawl relations derived from the `pages` table by rules on page_id, in SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_SQL = """
    SELECT page_id AS ord, url,
           CASE WHEN page_id % 20 = 7 THEN 404 WHEN page_id % 33 = 5 THEN 0 WHEN page_id % 27 = 4 THEN 301 WHEN page_id % 41 = 3 THEN 503 ELSE 200 END AS status_code,
           CASE WHEN page_id % 20 <> 7 AND page_id % 33 = 5 THEN CASE page_id % 4 WHEN 0 THEN 'dns_not_found' WHEN 1 THEN 'timeout' WHEN 2 THEN 'too_many_redirects' ELSE 'connection_refused' END END AS error_type,
           '' AS error, 'text/html' AS content_type, (page_id * 7919) % 5000000 AS size, page_id % 11 <> 0 AS is_internal,
           CAST(page_id % 5 AS INT) AS depth, CAST((page_id * 37) % 4000 AS DOUBLE) AS response_time,
           regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
           CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN '' ELSE concat(url, '/c') END AS canonical_url,
           CASE WHEN page_id % 4 = 0 THEN '' ELSE 'width=device-width' END AS viewport,
           CASE WHEN page_id % 10 = 0 THEN 'NOINDEX,nofollow' WHEN page_id % 7 = 0 THEN 'nofollow' ELSE '' END AS robots,
           CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN repeat('d', 170) WHEN 2 THEN concat('Short text ', CAST(page_id % 90 AS VARCHAR(9))) ELSE repeat(regexp_extract(html, '<h1>([^<]*)</h1>', 1), 3) END AS meta_description,
           CAST((page_id * 53) % 700 AS INT) AS word_count, page_id % 5 <> 0 AS has_og, page_id % 3 = 0 AS has_twitter, page_id % 2 = 0 AS has_json_ld, page_id % 4 AS n_images
    FROM pages
"""  # noqa: S608
LINKS_SQL = """
    SELECT a.ord * 5 + a.k AS ord, a.url AS source_url, b.url AS target_url, concat('anchor ', CAST(a.k AS VARCHAR(9))) AS anchor_text,
           NOT (a.k = 2 AND a.ord % 6 = 0) AS is_internal, CASE WHEN a.ord % 9 = 0 THEN NULL ELSE b.status_code END AS target_status,
           CASE a.k WHEN 0 THEN 'body' WHEN 1 THEN 'navigation' WHEN 2 THEN 'footer' WHEN 3 THEN 'body' ELSE 'image' END AS placement
    FROM (
        SELECT ord, url, k, CASE k WHEN 0 THEN (7 * ord + 3) % n WHEN 1 THEN CAST(floor(ord / 2) AS BIGINT) WHEN 2 THEN (5 * ord + 1) % n WHEN 3 THEN 0 ELSE (3 * ord + 2) % n END AS target
        FROM (SELECT ord, url, (SELECT max(ord) + 1 FROM crawl_pages) AS n FROM crawl_pages) CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS v(k)
        WHERE k < 4 OR ord % 4 = 0) a
    JOIN crawl_pages b ON b.ord = a.target
"""
SITEMAP_SQL = """
    SELECT ord, url FROM crawl_pages WHERE ord % 2 = 0
    UNION ALL SELECT ord + 1000000 AS ord, concat('https://absent.example.org/p/', CAST(ord AS VARCHAR(20))) AS url FROM crawl_pages WHERE ord % 5 = 0
"""
VARIANTS_SQL = """
    SELECT ord * 6 AS ord, url FROM crawl_pages
    UNION ALL SELECT ord * 6 + 1, replace(url, '://', '://www.') FROM crawl_pages
    UNION ALL SELECT ord * 6 + 2, concat(url, '#part') FROM crawl_pages WHERE NOT url LIKE '%#%'
    UNION ALL SELECT ord * 6 + 3, concat(url, '/') FROM crawl_pages WHERE NOT url LIKE '%#%' AND NOT url LIKE '%?%'
    UNION ALL SELECT ord * 6 + 4, concat(url, '/index.html') FROM crawl_pages WHERE NOT url LIKE '%#%' AND NOT url LIKE '%?%' AND NOT url LIKE '%/'
"""

#: Pages with tags of their own in head and body, every fourth JSON-LD cut.
TAGGED_SQL = """
    SELECT page_id, page_id AS ord, url, regexp_extract(url, '^[a-z]+://[^/]+', 0) AS host,
           replace(replace(html, '</head>', concat('<meta name="description" content=" D', page_id, ' "><meta name="viewport" content="w', page_id, '"><meta name="robots" content="r', page_id, '"><meta name="author" content="A', page_id,
               '"><meta property="og:title" content="OG', page_id, '"><meta name="twitter:card" content="T', page_id, '"><link rel="canonical" href="/c', page_id, '"><link rel="alternate" hreflang="fr" href="/fr', page_id,
               '"><script type="application/ld+json">', CASE WHEN page_id % 4 = 0 THEN concat(chr(123), 'cut') ELSE concat(chr(123), '"a": ', page_id, chr(125)) END, '</script></head>')),
               '<body>', concat('<body><div itemtype="http://schema.org/Product"><b itemprop="name"> N', page_id, ' </b><meta itemprop="sku" content="', page_id, '"></div><img src="/i', page_id, '.png" alt="a', page_id, '" width="', page_id,
               '"><img src="//cdn.example/', page_id % 7, '.png"><h2>x', page_id, '</h2><h3>y</h3><footer><a href="/foot', page_id, '">f', page_id, '</a></footer>')) AS html
    FROM pages
"""

#: Views of the oracle, in front of each query.
ORACLE_WITH = f"crawl_pages AS ({BASE_SQL}), crawl_links AS ({LINKS_SQL}), crawl_sitemap AS ({SITEMAP_SQL}), url_variants AS ({VARIANTS_SQL})"



def _with(spark: SparkSession, sql: str, views: dict[str, DataFrame]) -> DataFrame:
    for name, df in views.items():
        sql = sql.replace(f" {name}", " {" + name + "}")
    return spark.sql(sql.replace("VARCHAR(9)", "STRING").replace("VARCHAR(20)", "STRING"), **views)


def crawl_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _with(spark, BASE_SQL, {"pages": spark.read.parquet(f"{sf_dir}/pages.parquet")})
    tag = lambda flag: F.when(F.col(flag), F.create_map(F.lit("title"), F.col("title"))).otherwise(F.create_map().cast("map<string,string>"))
    hop = lambda u, c: F.struct(u.alias("url"), F.lit(c).alias("status_code"))
    u, none = F.col("url"), F.array().cast("array<struct<url:string,status_code:int>>")
    hops = F.when(F.col("ord") % 10 == 1, F.array(hop(u, 301), hop(F.concat(u, F.lit("/h1")), 302))).when(F.col("ord") % 30 == 2, F.array(hop(u, 301), hop(F.concat(u, F.lit("/a")), 302), hop(u, 301)))
    final = F.when(F.col("ord") % 10 == 1, F.concat(u, F.lit("/f"))).when(F.col("ord") % 30 == 2, F.concat(u, F.lit("/a"))).otherwise(u)
    image = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(F.concat(u, F.lit("/i"), i.cast("string"), F.lit(".png")).alias("src"), F.when(i % 2 == 1, "").otherwise("alt").alias("alt"), F.lit("").alias("width"), F.lit("").alias("height")))
    broken = F.when(F.col("ord") % 13 == 0, F.array(F.struct(F.concat(u, F.lit("/i0.png")).alias("url"), F.lit(404).alias("status")), F.struct(F.concat(u, F.lit("/i1.png")).alias("url"), F.lit(0).alias("status"))))
    return base.withColumns({
        "og_tags": tag("has_og"), "twitter_tags": tag("has_twitter"), "json_ld": F.when(F.col("has_json_ld"), F.array(F.lit("{}"))).otherwise(F.array().cast("array<string>")),
        "schema_org": F.array().cast("array<struct<type:string,properties:map<string,string>>>"), "redirects": F.coalesce(hops, none), "final_url": final,
        "images": F.slice(image, F.lit(1), F.least(F.col("n_images"), F.lit(3)).cast("int")), "broken_images": broken, "h2": F.array().cast("array<string>"), "h3": F.array().cast("array<string>"),
    }).drop("has_og", "has_twitter", "has_json_ld", "n_images")


def tagged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with(spark, TAGGED_SQL, {"pages": spark.read.parquet(f"{sf_dir}/pages.parquet")})


def crawl_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = crawl_pages(spark, sf_dir).select("ord", "url", "status_code")
    return _with(spark, LINKS_SQL, {"crawl_pages": p}).withColumn("target_domain", F.regexp_extract("target_url", "^[a-z]+://([^/]*)", 1))


def crawl_sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with(spark, SITEMAP_SQL, {"crawl_pages": crawl_pages(spark, sf_dir).select("ord", "url")})


def url_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with(spark, VARIANTS_SQL, {"crawl_pages": crawl_pages(spark, sf_dir).select("ord", "url")})
