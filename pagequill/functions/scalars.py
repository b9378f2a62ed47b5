"""Scalar functions of the audit, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STATUS_MESSAGES = {
    400: "Bad Request", 401: "Unauthorized", 403: "Forbidden", 404: "Not Found", 405: "Method Not Allowed",
    406: "Not Acceptable", 408: "Request Timeout", 410: "Gone", 429: "Too Many Requests", 500: "Internal Server Error",
    501: "Not Implemented", 502: "Bad Gateway", 503: "Service Unavailable", 504: "Gateway Timeout", 505: "HTTP Version Not Supported",
}
DNS_MARKERS = (
    "getaddrinfo failed", "name or service not known", "name resolution", "nodename nor servname", "no address associated",
    "name does not resolve", "temporary failure in name resolution", "name_not_resolved", "err_name_not_resolved", "nxdomain",
)
STOPWORDS = (
    "the a an and or but of to in for on with at by from as is are was were be been "
    "this that these those it its your our their his her you we they i he she "
    "what which who how why when where all any can will just not no do does did "
    "has have had more most other some such only own same so than too very s t "
    "if then else out up down over under again once here there"
).split()
GRADES = (("F", 0.97), ("D", 0.92), ("C", 0.87), ("B", 0.83))
SEVERITIES = (("critical", 75), ("high", 50), ("medium", 30))


def missing(c: Column | str) -> Column:
    """Empty or null text."""
    return F.coalesce(F.length(c), F.lit(0)) == 0


def missing_list(c: Column | str) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) <= 0


def ladder(value: Column, steps: tuple, otherwise: str) -> Column:
    out = None
    for name, least in steps:
        out = F.when(value >= least, name) if out is None else out.when(value >= least, name)
    return out.otherwise(otherwise)


def status_bucket(code: Column) -> Column:
    code = F.coalesce(code, F.lit(0))
    return F.when(code == 0, "no_response").otherwise(F.concat(F.floor(code / 100).cast("string"), F.lit("xx")))


def status_message(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in STATUS_MESSAGES.items() for x in kv])
    return F.coalesce(F.get(F.transform(F.array(code), lambda c: F.try_element_at(table, c)), F.lit(0)), F.concat(F.lit("HTTP "), code.cast("string"), F.lit(" Error")))


def fetch_error(message: Column) -> Column:
    """Class of a fetch failure by its message, the first rule that holds."""
    m = F.lower(F.coalesce(message, F.lit("")))
    has = lambda *words: F.reduce(F.array(*[m.contains(w) for w in words]), F.lit(False), lambda a, x: a | x)
    return (
        F.when(has(*DNS_MARKERS), "dns_not_found")
        .when(has("redirect") & has("exceeded", "too many"), "too_many_redirects")
        .when(has("timed out", "timeout"), "timeout")
        .when(has("refused"), "connection_refused")
        .when(has("ssl", "certificate", "err_cert", "tls"), "ssl_error")
        .otherwise("connection_error")
    )


def places(value: Column, n: int) -> Column:
    """value to n decimals as C and DuckDB do it: the product with 10^n is rounded, not the shortest decimal text."""
    return F.round(value * F.lit(10.0**n)) / F.lit(10.0**n)


def scale(value: Column, top: Column, lo: float, hi: float) -> Column:
    """lo..hi by the square root of the share of top, one decimal."""
    share = F.least(F.greatest(value / top, F.lit(0.0)), F.lit(1.0))
    return F.when(F.coalesce(top, F.lit(0.0)) <= 0, F.lit(float(lo))).otherwise(F.round(F.lit(lo) + F.lit(hi - lo) * F.sqrt(share), 1))


def flow_role(inflow: Column, outflow: Column) -> Column:
    return F.when((inflow < 0.1) & (outflow < 0.1), "balanced").when(inflow > outflow * 1.25, "receiver").when(outflow > inflow * 1.25, "donor").otherwise("balanced")


def similarity_grade(avg: Column, size: Column) -> Column:
    return ladder(avg + F.least(size, F.lit(20)) / 100, GRADES, "A")


def severity(score: Column) -> Column:
    return ladder(score, SEVERITIES, "low")


def tokens(text: Column) -> Column:
    """ASCII words of the lower-cased text, without stop words and single characters."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(found, lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))


def page_text(title: Column, description: Column, h1: Column, h2: Column, h3: Column) -> Column:
    parts = [title, description, h1, F.array_join(h2, " "), F.array_join(h3, " ")]
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def word_count(text: Column) -> Column:
    """Unicode words."""
    return F.regexp_count(text, F.lit(r"(?U)\b\w+\b"))


def analytics_labels(a: str = "analytics") -> Column:
    f = lambda n: F.coalesce(F.col(f"{a}.{n}"), F.lit(False))
    return F.concat_ws(
        ", ",
        F.when(f("gtag") | ~missing(f"{a}.ga4_id"), "GA4"),
        F.when(f("google_analytics"), "GA"),
        F.when(~missing(f"{a}.gtm_id"), "GTM"),
        F.when(f("facebook_pixel"), "FB"),
        F.when(f("hotjar"), "HJ"),
        F.when(f("mixpanel"), "MP"),
    )


def counted(c: str, noun: str) -> Column:
    return F.when(missing_list(c), "").otherwise(F.concat(F.size(c).cast("string"), F.lit(f" {noun}")))


def first_three(c: str) -> Column:
    return F.when(missing_list(c), "").otherwise(F.concat(F.array_join(F.slice(c, 1, 3), ", "), F.when(F.size(c) > 3, "...").otherwise("")))


def detect_analytics(html: Column) -> Column:
    """Struct of trackers found in raw HTML."""
    ga4, gtm = F.regexp_extract(html, "G-[A-Z0-9]{10}", 0), F.regexp_extract(html, "GTM-[A-Z0-9]+", 0)
    ga = r"(?i)gtag\(|ga\(|GoogleAnalyticsObject|google-analytics\.com|googletagmanager\.com"
    return F.struct(
        (ga4 != "").alias("gtag"),
        html.rlike(ga).alias("google_analytics"),
        html.rlike(r"(?i)fbq\(|facebook\.com/tr").alias("facebook_pixel"),
        html.rlike(r"(?i)hotjar\.com|hj\(").alias("hotjar"),
        html.rlike(r"(?i)mixpanel\.com|mixpanel\.track").alias("mixpanel"),
        ga4.alias("ga4_id"),
        gtm.alias("gtm_id"),
    )
