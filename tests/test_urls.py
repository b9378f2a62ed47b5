import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagequill.functions import scalars, urls

CASES = [
    ("HTTP://Example.COM:80", False, "http://example.com/"),
    ("https://example.com:8443/a b", False, "https://example.com:8443/a%20b"),
    ("https://example.com/?b=2&a=1#top", False, "https://example.com/?a=1&b=2"),
    ("https://www.example.com/dir/index.html", True, "https://example.com/dir"),
    ("https://example.com/dir//", True, "https://example.com/dir"),
    ("https://example.com/?x", False, "https://example.com/?x="),
    ("mailto:a@b.c", False, "mailto:a@b.c"),
    ("http://h:99999/", False, "http://h:99999/"),
    ("", False, ""),
    (None, False, None),
]


@pytest.mark.parametrize("url,aggressive,want", CASES)
def test_canonical(url, aggressive, want):
    assert urls.canonical(url, aggressive) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["http", "https", "://", "www.", "a.com", "/", "index.html", "?", "x=1", "&", "b", "#f", "%41", "A"]), min_size=3, max_size=9))
def test_canonical_is_idempotent(parts):
    """Index files go before trailing slashes do, so an index file that had a slash behind it is left, and would go the next time."""
    url = "http://a.com/" + "".join(parts)
    plain = urls.canonical(url)
    assert urls.canonical(plain) == plain
    once = urls.canonical(url, True)
    assert urls.canonical(once, True) == once or re.search(r"/index\.html$", once.split("?")[0])


def test_index_file_with_a_slash_behind_it():
    assert urls.canonical("http://a.com/b/index.html/", True) == "http://a.com/b/index.html"
    assert urls.canonical("http://a.com/b/index.html", True) == "http://a.com/b"


def test_native_equals_exact(spark):
    seen = ["http://a.com", "http://www.a.com/x/", "https://b.org/p/index.html?q=1#z", "https://b.org/p?b=1&a=2", "http://a.com/%7Ex", "ftp://a", None, "", "https://c.net/a//b/", "http://a.com/Index.HTML"]
    df = spark.createDataFrame([(u,) for u in seen], "u string")
    for aggressive in (False, True):
        got = [r[0] for r in df.select(urls.normalize_url(F.col("u"), aggressive)).collect()]
        assert got == [urls.canonical(u, aggressive) for u in seen]


def test_parts(spark):
    df = spark.createDataFrame([("https://www.a.com/x/y?q=1",), ("http://awww.com/",), ("not a url",)], "u string")
    u = F.col("u")
    rows = df.select(urls.is_parameterized(u), urls.cluster_id(u), urls.page_label(u), urls.extract_domain(u)).collect()
    assert tuple(rows[0]) == (True, "/x/", "y", "a.com")
    assert tuple(rows[1]) == (False, "/", "/", "awww.com")
    assert rows[2][0] is False


def test_fetch_error_order(spark):
    df = spark.createDataFrame([("SSL handshake timed out",), ("getaddrinfo failed",), (None,)], "m string")
    assert [r[0] for r in df.select(scalars.fetch_error(F.col("m"))).collect()] == ["timeout", "dns_not_found", "connection_error"]
