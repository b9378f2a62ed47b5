import pytest
from pyspark.sql import functions as F

from pagequill.operators import filters, linkgraph, setchecks, similarity, tree
from pagequill.operators.components import connected_components
from pagequill.sources import html, sitemap, store
from pagequill.streaming import live

PAGE = "ord long, url string, status_code int, is_internal boolean, depth int, title string, meta_description string, h1 string, word_count int, error string, error_type string, content_type string, final_url string, redirects array<struct<url:string,status_code:int>>, h2 array<string>, h3 array<string>, robots string"


def pages(spark, *rows):
    base = {"status_code": 200, "is_internal": True, "depth": 1, "title": "", "meta_description": "", "h1": "", "word_count": 0, "error": "", "error_type": None, "content_type": "text/html", "final_url": "", "redirects": [], "h2": [], "h3": [], "robots": ""}
    return spark.createDataFrame([{"ord": i} | base | r for i, r in enumerate(rows)], PAGE)


def links(spark, *rows):
    out = [(i, s, t, "x", True, "", 200, p) for i, (s, t, p) in enumerate(rows)]
    return spark.createDataFrame(out, "ord long, source_url string, target_url string, anchor_text string, is_internal boolean, target_domain string, target_status int, placement string")


def test_redirects(spark):
    hops = lambda *u: [{"url": x, "status_code": 301} for x in u]
    df = pages(
        spark,
        {"url": "http://a/1", "redirects": hops("http://a/1", "http://a/2"), "final_url": "http://a/3"},
        {"url": "http://a/4", "redirects": hops("http://a/4", "http://a/5"), "final_url": "http://a/4/"},
        {"url": "http://a/6", "redirects": hops("http://a/6"), "final_url": "http://a/7", "status_code": 404},
        {"url": "http://a/8", "status_code": 0, "error_type": "too_many_redirects"},
    )
    got = {(r["url"], r["issue"]) for r in setchecks.redirect_issues(df).collect()}
    assert got == {("http://a/1", "Redirect Chain"), ("http://a/4", "Redirect Loop"), ("http://a/6", "Redirect to Error Page"), ("http://a/8", "Redirect Loop")}


def test_duplicates_fold_case_and_space(spark):
    df = pages(spark, {"url": "u1", "title": "A  b"}, {"url": "u2", "title": "a B "}, {"url": "u3", "title": "c"}, {"url": "u4", "title": "a b", "status_code": 404})
    got = setchecks.duplicate_issues(df).collect()
    assert {r["url"] for r in got} == {"u1", "u2"} and all("shared by 2 pages" in r["details"] for r in got)


def test_flows_are_the_same_in_any_order_and_round_as_sql(spark):
    """Three tenths and so on sum to their decimal value; 8.075 is rounded by its product with 100, which is below the half."""
    edges = [("http://a/0", f"http://a/{i}", w, i) for i, w in enumerate((0.1, 0.2, 0.3, 0.1, 0.3), 1)]
    df = spark.createDataFrame(edges, "s string, t string, weight double, ord long")
    metrics = spark.createDataFrame([("http://a/0", 10.0)], "norm string, authority_score double")
    got = {r["t"]: r["flow"] for r in linkgraph.flows(df, metrics).collect()}
    assert got == {t: 10.0 * w / 1.0 for _, t, w, _ in edges}
    flow = spark.createDataFrame([("p", "x", 8.075, 2), ("q", "x", 8.075 - 1e-12, 1), ("p", "z", 15.675, 1)], "s string, t string, flow double, ord long")
    assert {r["node"]: (r["parent"], r["flow"]) for r in tree.authority_parents(flow, "home").collect()} == {"x": ("q", 8.07), "z": ("p", 15.68)}
    many = spark.createDataFrame([(f"n{i}", "x", 0.1, i) for i in range(10)], "s string, t string, flow double, ord long")
    assert {r["norm"]: r["inflow"] for r in linkgraph.node_flows(many).collect()}["x"] == 1.0


def test_references_in_titles_are_decoded():
    """As the reference's parser does, quotes and references that a cut title has lost the semicolon of too."""
    assert html.extract("http://a/", "<title>token = &quot;5a&quot; &amp; x &amp</title>")["title"] == 'token = "5a" & x &'


def test_fuzzy_matches_difflib(spark):
    import difflib

    texts = ["red shoes for running", "red shoes for runners", "blue hats", "red shoes for running"]
    df = pages(spark, *[{"url": f"u{i}", "title": t, "meta_description": t + " today", "h1": t, "word_count": 10} for i, t in enumerate(texts)])
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    want = {(f"u{i}", f"u{j}") for i in range(4) for j in range(i + 1, 4) if 0.55 * ratio(texts[i], texts[j]) + 0.35 * ratio(texts[i] + " today", texts[j] + " today") + 0.1 >= 0.85}
    assert {(r["url_a"], r["url_b"]) for r in setchecks.fuzzy_pairs(df).collect()} == want
    with pytest.raises(ValueError):
        setchecks.fuzzy_pairs(df, 0.6)


def test_fuzzy_pairs_over_cells_are_all_pairs(spark, monkeypatch):
    """Texts of the same letters, which bounds by letters don't tell apart, over many cells."""
    import difflib
    import random

    monkeypatch.setattr(setchecks, "CELL", 20)
    monkeypatch.setattr(setchecks, "SLICE", 7)
    r, words = random.Random(5), ["alpha", "bravo", "carbon", "delta", "ember", "falcon"]
    rows = []
    for i in range(120):
        w = r.sample(words, len(words)) if i % 3 else [*words[:4], *r.sample(words[4:], 2), str(i)]
        rows.append({"url": f"u{i}", "title": " ".join(w), "meta_description": " ".join(w * r.choice((1, 1, 3))), "h1": " ".join(w[1:]) if i % 7 else "", "word_count": i % 5})
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0
    want = {}
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            both = sorted((a["word_count"], b["word_count"]))
            score = 0.35 * ratio(a["title"], b["title"]) + 0.35 * ratio(a["meta_description"], b["meta_description"]) + 0.2 * ratio(a["h1"], b["h1"]) + 0.1 * (both[0] / both[1] if both[0] else 0.0)
            if score >= 0.85:
                want[a["url"], b["url"]] = score
    work = []
    got = {(x["url_a"], x["url_b"]): x["similarity"] for x in setchecks.fuzzy_pairs(pages(spark, *rows), work=work).collect()}
    assert got == pytest.approx(want) and len(want) > 20
    assert work[0] < 2 * len(want) < 120 * 119 / 2 / 4


def test_graph_in_one_task_equals_distributed(spark, monkeypatch):
    df = pages(spark, *[{"url": f"http://a/{i}", "depth": i} for i in range(6)])
    ls = links(spark, *[(f"http://a/{i}", f"http://a/{(i * 3 + 1) % 6}", "body") for i in range(5)], ("http://a/0", "http://www.a/2/", "navigation"))
    m = linkgraph.page_metrics(df, ls).select("norm", "authority_score", "is_orphan").collect()
    monkeypatch.setattr(linkgraph, "SMALL", 0)
    nodes, w = linkgraph.internal_pages(df), linkgraph.edges(df, ls)
    slow = {r["norm"]: r["score"] for r in linkgraph.authority(nodes, w, rounds=30).collect()}
    assert {r["norm"]: r["authority_score"] for r in m} == pytest.approx(slow)
    assert max(slow.values()) == 100.0


def test_bfs_takes_first_discoverer(spark):
    df = pages(spark, *[{"url": f"http://a/{i}"} for i in range(4)])
    ls = links(spark, ("http://a/0", "http://a/1", "body"), ("http://a/0", "http://a/2", "body"), ("http://a/2", "http://a/3", "body"), ("http://a/1", "http://a/3", "body"))
    got = {r["node"]: (r["parent"], r["level"]) for r in tree.bfs_tree(linkgraph.internal_pages(df), ls, "http://a/0").collect()}
    assert got["http://a/3"] == ("http://a/1", 2)
    with pytest.raises(ValueError):
        tree.build_graph(df, ls, focus="http://a/nowhere")


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 1), (7, 7)], "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(e).collect()}
    assert got == {1: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}
    assert connected_components(e.limit(0)).count() == 0


def test_similarity(spark):
    df = pages(spark, *[{"url": f"u{i}", "title": t} for i, t in enumerate(["red running shoes sale", "red running shoes sale", "garden chairs wooden table", "ok"])])
    r = similarity.content_similarity(df)
    assert (r.analyzed, r.skipped) == (3, 1)
    assert {x["doc"] for x in r.clusters.collect()} == {0, 1}
    assert {x["url"]: x["similarity"] for x in r.pages.collect()} == {"u0": 1.0, "u1": 1.0, "u2": 0.0}


def test_html_and_links(spark):
    page = """<html lang=en><head><title>T</title><meta name=description content=D><meta property="og:title" content=O>
      <script type="application/ld+json">{"a": 1}</script><link rel=canonical href=/c></head><body><nav><a href="/n">N</a></nav>
      <p><b>x<a href="https://other.com/">o</a><a href="#x">skip</a><img src="//cdn/i.png"><div class="main-menu"><a href="m">M</a></div>
      <footer><a href="/n">again</a><a href="/f">F</a></footer></body></html>"""
    x = html.extract("https://a.com/d/", page)
    assert (x["title"], x["meta_description"], x["og_tags"], x["canonical_url"], x["internal_links"], x["external_links"]) == ("T", "D", {"title": "O"}, "/c", 4, 1)
    got = {(v["target_url"], v["placement"]) for v in x["links"]}
    assert got == {("https://a.com/n", "navigation"), ("https://other.com/", "body"), ("https://cdn/i.png", "image"), ("https://a.com/d/m", "navigation"), ("https://a.com/f", "footer")}


def test_patterns(spark):
    df = spark.createDataFrame([("http://a/amplifier",), ("http://a/x/search/y",), ("http://a/ok",), ("http://a/f.min.js",)], "u string")
    assert [r[0] for r in df.select(filters.excluded(F.col("u"))).collect()] == [True, True, False, True]
    assert filters.setting_errors({"max_depth": 0, "timeout": "x", "retries": 3}) == ["max_depth", "timeout"]


def test_sitemap(spark):
    files = {"http://a/sitemap.xml": b"<sitemapindex xmlns='n'><sitemap><loc>http://a/s2.xml</loc></sitemap></sitemapindex>", "http://a/s2.xml": b"<urlset><url><loc>http://a/1</loc></url><url><loc>http://a/1</loc></url></urlset>"}
    fetch = lambda us: spark.createDataFrame([(u, bytearray(files.get(u, b"no"))) for u in us], "url string, body binary")
    assert [r["url"] for r in sitemap.discover_sitemaps(spark, "http://a", fetch).collect()] == ["http://a/1"]


def test_store_and_stream(spark, tmp_path):
    s = store.CrawlStore(spark, f"file://{tmp_path}/store")
    row = spark.sql("select 1L crawl_id, 7L user_id, 'http://a' base_url, 'running' status, current_timestamp() started_at, cast(null as timestamp) completed_at, 0L urls_crawled, '' config, '' checkpoint")
    s.record(row)
    s.save("pages", pages(spark, {"url": "u"}), 1)
    assert s.load("pages", 1).count() == 1
    s.fail_running()
    assert [r["status"] for r in s.list().collect()] == ["failed"]
    s.delete(1)
    assert s.list().count() == 0
    pages(spark, {"url": "u"}, {"url": "v"}).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    live.save_stream(stream, s, "pages", 2, f"{tmp_path}/check", once=True).awaitTermination()
    assert s.load("pages", 2).count() == 2
