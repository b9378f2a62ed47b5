"""Schemas of the crawl relations. `ord` is the crawl sequence; "first wins" rules order by it."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()
IMAGE = T.StructType([T.StructField(n, _S) for n in ("src", "alt", "width", "height")])
HOP = T.StructType([T.StructField("url", _S), T.StructField("status_code", T.IntegerType())])
HREFLANG = T.StructType([T.StructField("lang", _S), T.StructField("url", _S)])
SCHEMA_ORG = T.StructType([T.StructField("type", _S), T.StructField("properties", T.MapType(_S, _S))])
BROKEN_IMAGE = T.StructType([T.StructField("url", _S), T.StructField("status", T.IntegerType())])
ANALYTICS = T.StructType(
    [T.StructField(n, T.BooleanType()) for n in ("gtag", "google_analytics", "facebook_pixel", "hotjar", "mixpanel")] + [T.StructField(n, _S) for n in ("ga4_id", "gtm_id")]
)

PAGE = T.StructType(
    [
        T.StructField("ord", T.LongType()),
        T.StructField("url", _S),
        T.StructField("normalized_url", _S),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("error_type", _S),
        T.StructField("error", _S),
        T.StructField("content_type", _S),
        T.StructField("size", T.LongType()),
        T.StructField("is_internal", T.BooleanType()),
        T.StructField("depth", T.IntegerType()),
        *(T.StructField(n, _S) for n in ("title", "meta_description", "h1")),
        T.StructField("h2", T.ArrayType(_S)),
        T.StructField("h3", T.ArrayType(_S)),
        T.StructField("word_count", T.IntegerType()),
        *(T.StructField(n, T.MapType(_S, _S)) for n in ("meta_tags", "og_tags", "twitter_tags")),
        *(T.StructField(n, _S) for n in ("canonical_url", "lang", "charset", "viewport", "robots", "author", "keywords", "generator", "theme_color")),
        T.StructField("json_ld", T.ArrayType(_S)),
        T.StructField("analytics", ANALYTICS),
        T.StructField("images", T.ArrayType(IMAGE)),
        T.StructField("internal_links", T.IntegerType()),
        T.StructField("external_links", T.IntegerType()),
        T.StructField("response_time", T.DoubleType()),
        T.StructField("redirects", T.ArrayType(HOP)),
        T.StructField("final_url", _S),
        T.StructField("hreflang", T.ArrayType(HREFLANG)),
        T.StructField("schema_org", T.ArrayType(SCHEMA_ORG)),
        T.StructField("broken_images", T.ArrayType(BROKEN_IMAGE)),
        T.StructField("javascript_rendered", T.BooleanType()),
    ]
)

LINK = T.StructType(
    [
        T.StructField("ord", T.LongType()),
        *(T.StructField(n, _S) for n in ("source_url", "target_url", "anchor_text")),
        T.StructField("is_internal", T.BooleanType()),
        T.StructField("target_domain", _S),
        T.StructField("target_status", T.IntegerType()),
        T.StructField("placement", _S),
    ]
)

ISSUE = T.StructType([T.StructField(n, _S) for n in ("url", "type", "category", "issue", "details")])
ISSUE_COLUMNS = ISSUE.fieldNames()
