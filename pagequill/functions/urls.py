"""URL functions. All but exact normalisation are plain columns."""

from __future__ import annotations

import re
from operator import itemgetter
from urllib.parse import SplitResult, parse_qsl, quote, unquote, urlencode, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Default ports, and index files that aggressive normalisation drops.
DEFAULT_PORTS = {"http": 80, "https": 443}
INDEX_FILES = ("index.html", "index.htm", "index.php", "default.html", "default.htm")
PATH_SAFE = "/:@!$&'()*+,;=~-._"


def _authority(p: SplitResult) -> str:
    """Credentials as they are, the host in lower case, and a port that the scheme doesn't imply."""
    login = ":".join(x for x in (p.username, p.password) if x) if p.username else ""
    port = "" if p.port is None or p.port == DEFAULT_PORTS[p.scheme] else str(p.port)
    return (login and login + "@") + ":".join(x for x in (p.hostname, port) if x)


def _query(text: str) -> str:
    """Parameters by name, those of one name in their order, encoded anew; a # or nothing at all leaves no mark."""
    pairs = parse_qsl(text, keep_blank_values=True)
    return "?" + urlencode(sorted(pairs, key=itemgetter(0))) if pairs else ""


_INDEX = re.compile("/(" + "|".join(map(re.escape, INDEX_FILES)) + ")$", re.IGNORECASE)


def _page_key(authority: str, path: str) -> str:
    """Authority and path as the aggressive form has them: what a site serves under several names is one page."""
    return authority.removeprefix("www.") + (_INDEX.sub("/", path).rstrip("/") or "/")


def canonical(url: str | None, aggressive: bool = False) -> str | None:
    """The normal form of one URL; what is no http(s) URL comes back as it is."""
    try:
        p = urlsplit((url or "").strip())
        if p.scheme not in DEFAULT_PORTS or not p.hostname:
            return url
        authority = _authority(p)
    except ValueError:
        return url
    path = quote(unquote(p.path or "/"), safe=PATH_SAFE)
    place = _page_key(authority, path) if aggressive else authority + path
    return p.scheme + "://" + place + _query(p.query)


@F.pandas_udf(T.StringType())
def _conservative(urls: pd.Series) -> pd.Series:
    return urls.map(canonical, na_action="ignore")


@F.pandas_udf(T.StringType())
def _aggressive(urls: pd.Series) -> pd.Series:
    return urls.map(lambda u: canonical(u, True), na_action="ignore")


#: URLs that need no decoding, sorting or port rule: lower-case host, plain path, at most one parameter with a value.
_SIMPLE = r"^https?://[a-z0-9-]+(\.[a-z0-9-]+)+(/[A-Za-z0-9_.~-]*)*(\?[A-Za-z0-9_.-]+=[A-Za-z0-9_.-]*)?(#[^\s]*)?$"


def normalize_url(url: Column, aggressive: bool = False) -> Column:
    """Normal form of a URL column.

    Simple URLs stay in the JVM; the rest go to Arrow batches of urllib. Both
    give the same form (tests/test_urls.py compares them). CASE evaluates its
    Python branch for a whole batch, so null goes in for simple URLs.
    """
    simple = F.coalesce(url.rlike(_SIMPLE), F.lit(False))
    bare = F.regexp_replace(url, r"#.*$", "")
    head = F.regexp_extract(bare, r"^https?://[^/?]+", 0)
    path = F.regexp_extract(bare, r"^https?://[^/?]+([^?]*)", 1)
    query = F.regexp_extract(bare, r"(\?.*)$", 1)
    if aggressive:
        head = F.regexp_replace(head, r"^(https?://)www\.", "$1")
        path = F.regexp_replace(path, r"(?i)(^|/)(" + "|".join(re.escape(x) for x in INDEX_FILES) + ")$", "$1")
        path = F.regexp_replace(path, r"/+$", "")
    path = F.when(path == "", "/").otherwise(path)
    exact = (_aggressive if aggressive else _conservative)(F.when(~simple, url))
    return F.when(simple, F.concat(head, path, query)).otherwise(exact)


def url_part(url: Column, part: str) -> Column:
    return F.try_parse_url(url, F.lit(part))


def is_parameterized(url: Column) -> Column:
    return F.coalesce(F.length(url_part(url, "QUERY")) > 0, F.lit(False))


def host_key(url: Column, anywhere: bool = False) -> Column:
    """Host and port without www.: the prefix only, or its first occurrence anywhere."""
    net = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(net, r"^(.*?)www\.", "$1") if anywhere else F.regexp_replace(net, r"^www\.", "")


def is_internal(url: Column, base: Column, anywhere: bool = False) -> Column:
    """Same host and port as base; sub-domains are external."""
    return host_key(url, anywhere) == host_key(base, anywhere)


def path_segments(url: Column) -> Column:
    path = F.coalesce(url_part(url, "PATH"), F.lit(""))
    return F.filter(F.split(path, "/"), lambda s: s != "")


def cluster_id(url: Column) -> Column:
    """/first-segment/ if the path has two segments or more, else /."""
    s = path_segments(url)
    return F.when(F.size(s) >= 2, F.concat(F.lit("/"), F.get(s, F.lit(0)), F.lit("/"))).otherwise("/")


def page_label(url: Column) -> Column:
    s = path_segments(url)
    return F.when(F.size(s) > 0, F.try_element_at(s, F.lit(-1))).otherwise("/")


def extract_domain(target: Column) -> Column:
    """Registrable text of a URL or bare host: lower case, no www. prefix; null if there is none."""
    t = F.trim(target)
    full = F.when(t.contains("://"), t).otherwise(F.concat(F.lit("https://"), t))
    net = F.lower(F.regexp_extract(full, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return F.nullif(F.regexp_replace(net, r"^www\.", ""), F.lit(""))
