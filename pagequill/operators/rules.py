"""Per-page issue rules: pure column code, for batch and streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequill.functions.scalars import missing, missing_list, status_message
from pagequill.operators.filters import excluded

# Names, texts and bounds of the rules.
TITLE, DESCRIPTION, WORDS = (30, 60), (120, 160), 300
SLOW_MS, SLUGGISH_MS, LARGE, MODERATE = 3000, 1000, 3 << 20, 1 << 20
FETCH_FAILURES = {
    "dns_not_found": ("DNS Not Found", "Domain does not resolve. The site may be expired or misconfigured."),
    "connection_refused": ("Connection Refused", "Server actively refused the connection."),
    "timeout": ("Request Timeout", "Server did not respond before the request timed out."),
    "ssl_error": ("SSL/TLS Error", "Could not establish a secure connection (certificate or TLS issue)."),
    "connection_error": ("Connection Error", "Could not connect to the server."),
}
OTHER_FAILURE = ("No Response", "No HTTP response received.")


def _issue(when: Column, kind: str, category: str, name: Column | str, details: Column | str) -> Column:
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(when, F.struct(F.lit(kind).alias("type"), F.lit(category).alias("category"), as_col(name).alias("issue"), as_col(details).alias("details")))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def page_rules() -> list[Column]:
    """Each rule as an array of issues (null entries where it does not apply)."""
    c = F.col
    n_title, n_desc = F.length("title"), F.length("meta_description")
    code = F.coalesce("status_code", F.lit(0))
    words = F.coalesce("word_count", F.lit(0))
    ms, size = F.coalesce("response_time", F.lit(0.0)), F.coalesce("size", F.lit(0))
    failed = (code == 0) & ~missing("error_type") & ~c("error_type").isin("file_too_large", "too_many_redirects")
    table = lambda i: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in FETCH_FAILURES.items() for x in (k, v[i])]), c("error_type")), F.lit(OTHER_FAILURE[i]))
    bare = F.size(F.filter("images", lambda i: missing(i["alt"])))
    robots = F.lower(F.coalesce("robots", F.lit("")))
    mb = lambda: F.format_string("%.1f", size / (1 << 20))
    one = [
        _issue(missing("title"), "error", "SEO", "Missing Title Tag", "Page has no title tag"),
        _issue(n_title > TITLE[1], "warning", "SEO", "Title Too Long", _text("Title is ", n_title, " characters (recommended: ≤60)")),
        _issue((n_title > 0) & (n_title < TITLE[0]), "warning", "SEO", "Title Too Short", _text("Title is ", n_title, " characters (recommended: 30-60)")),
        _issue(missing("meta_description"), "error", "SEO", "Missing Meta Description", "Page has no meta description"),
        _issue(n_desc > DESCRIPTION[1], "warning", "SEO", "Meta Description Too Long", _text("Description is ", n_desc, " characters (recommended: ≤160)")),
        _issue((n_desc > 0) & (n_desc < DESCRIPTION[0]), "warning", "SEO", "Meta Description Too Short", _text("Description is ", n_desc, " characters (recommended: 120-160)")),
        _issue(missing("h1"), "error", "SEO", "Missing H1 Tag", "Page has no H1 heading"),
        _issue(words < WORDS, "warning", "Content", "Thin Content", _text("Page has only ", words, " words (recommended: ≥300)")),
        _issue(failed, "error", "Technical", table(0), F.coalesce(F.nullif(c("error"), F.lit("")), table(1))),
        _issue((code >= 400) & (code < 500), "error", "Technical", _text(code, " Client Error"), status_message(code)),
        _issue(code >= 500, "error", "Technical", _text(code, " Server Error"), status_message(code)),
        _issue((code >= 300) & (code < 400), "info", "Technical", _text(code, " Redirect"), "URL redirects to another location"),
        _issue(missing("canonical_url"), "warning", "Technical", "Missing Canonical URL", "Page has no canonical URL specified"),
        _issue(~missing("canonical_url") & (c("canonical_url") != c("url")), "warning", "Technical", "Canonical URL Different", _text("Canonical points to: ", c("canonical_url"))),
        _issue(missing("viewport"), "error", "Mobile", "Missing Viewport Meta Tag", "Page is not mobile-optimized"),
        _issue(missing("lang"), "warning", "Accessibility", "Missing Language Attribute", "HTML tag has no lang attribute"),
        _issue(bare > 0, "warning", "Accessibility", "Images Without Alt Text", _text(bare, " of ", F.size("images"), " images lack alt text")),
        _issue(missing_list("og_tags"), "warning", "Social", "Missing OpenGraph Tags", "Page has no OpenGraph tags for social sharing"),
        _issue(missing_list("twitter_tags"), "warning", "Social", "Missing Twitter Card Tags", "Page has no Twitter Card tags"),
        _issue(missing_list("json_ld") & missing_list("schema_org"), "error", "Structured Data", "No Structured Data", "Page has no JSON-LD or Schema.org markup"),
        _issue(ms > SLOW_MS, "error", "Performance", "Slow Response Time", _text("Page took ", ms, "ms to respond (recommended: <3000ms)")),
        _issue((ms > SLUGGISH_MS) & (ms <= SLOW_MS), "warning", "Performance", "Moderate Response Time", _text("Page took ", ms, "ms to respond (recommended: <1000ms)")),
        _issue(size > LARGE, "error", "Performance", "Large Page Size", _text("Page size is ", mb(), "MB (recommended: <3MB)")),
        _issue((size > MODERATE) & (size <= LARGE), "warning", "Performance", "Moderate Page Size", _text("Page size is ", mb(), "MB (recommended: <1MB)")),
        _issue(robots.contains("noindex"), "error", "Indexability", "Noindex Tag Present", "Page is BLOCKED from search engines - has noindex directive"),
        _issue(robots.contains("nofollow"), "error", "Indexability", "Nofollow Tag Present", "Links on this page are NOT followed by search engines - has nofollow directive"),
    ]
    kind = "array<struct<type:string,category:string,issue:string,details:string>>"
    broken = F.transform(
        F.coalesce("broken_images", F.array().cast("array<struct<url:string,status:int>>")),
        lambda b: F.when(b["status"] == 0, F.struct(F.lit("error").alias("type"), F.lit("Content").alias("category"), F.lit("Broken Image (No Response)").alias("issue"), F.concat(F.lit("Image does not respond: "), b["url"]).alias("details"))).when(
            b["status"] >= 400,
            F.struct(F.lit("error").alias("type"), F.lit("Content").alias("category"), F.concat(F.lit("Broken Image ("), b["status"].cast("string"), F.lit(")")).alias("issue"), F.concat(F.lit("Image returned "), b["status"].cast("string"), F.lit(": "), b["url"]).alias("details")),
        ),
    )
    return [F.array(*one).cast(kind), broken.cast(kind)]


def detect_issues(pages: DataFrame, exclusions: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Issue rows of every page that no exclusion pattern matches, with the page's columns in keep. Works on a stream."""
    rows = pages.where(~excluded(F.col("url"), exclusions)) if exclusions else pages
    issues = F.array_compact(F.flatten(F.array(*page_rules())))
    return rows.select("url", *keep, F.explode(issues).alias("i")).select("url", "i.*", *keep)
