"""What must not grow with depth, hosts or crawls: plans, waiting, repeated requests."""

import http.server
import threading
import time
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from pagequill.functions import shared
from pagequill.operators import filters, linkgraph, tree, views
from pagequill.sources import fetch


class Site(http.server.ThreadingHTTPServer):
    """A local site that notes what is asked; /bad answers 404, /slow leads elsewhere."""

    def __init__(self):
        self.asked = []

        class Handler(http.server.BaseHTTPRequestHandler):
            def answer(h):  # noqa: N805
                self.asked.append((h.command, h.path, time.time()))
                h.send_response(404 if "bad" in h.path else 200)
                h.send_header("Content-Type", "text/html")
                h.end_headers()
                if h.command == "GET":
                    h.wfile.write(b"<title>t</title>")

            do_GET = do_HEAD = answer  # noqa: N815

            def log_message(h, *a):  # noqa: N805
                pass

        super().__init__(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server_address[1]}"
        threading.Thread(target=self.serve_forever, daemon=True).start()


def test_reachable_by_pointer_doubling(spark):
    """A chain, a star, cycles, and chains that end elsewhere."""
    chain = [(f"n{i}", f"n{i - 1}" if i else "root") for i in range(3000)]
    star = [(f"s{i}", "n5") for i in range(2000)]
    lost = [("a", "b"), ("b", "c"), ("c", "a"), ("tail", "a"), ("x", "nowhere"), ("y", "x"), ("self", "self"), ("root", "a")]
    df = spark.createDataFrame(chain + star + lost, "node string, parent string")
    got = [r["node"] for r in tree.reachable(df, "root").collect()]
    assert sorted(got) == sorted(["root", *[n for n, _ in chain + star]])
    assert [r["node"] for r in tree.reachable(df.limit(0), "root").collect()] == ["root"]


def test_without(spark):
    rows = spark.range(2000).select((F.col("id") * 3).cast("string").alias("k"), "id")
    members = spark.range(3000).select(F.col("id").cast("string").alias("k"))
    got = {r["id"] for r in shared.without(rows, "k", members).collect()}
    assert got == {i for i in range(2000) if 3 * i >= 3000}
    assert shared.without(rows, "k", members.limit(0)).count() == 2000


def test_deep_crawl_and_tree(spark):
    """Forty levels; each plan reads folders, whose number alone grows."""
    html = [(f"http://a.x/{i}", f'<a href="/{i + 1}">n</a><a href="/{max(i - 3, 0)}">b</a>') for i in range(12)]
    site = spark.createDataFrame(html, "url string, html string")
    scope = filters.CrawlScope("http://a.x/0", max_depth=11)
    pages, links = fetch.crawl(spark.createDataFrame([("http://a.x/0",)], "url string"), scope, fetch.table_fetch(site))
    assert [(r["url"], r["depth"]) for r in pages.orderBy("ord").collect()] == [(f"http://a.x/{i}", i) for i in range(12)]
    plan = pages._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Union" not in plan
    chain = spark.createDataFrame([(f"http://a.x/{i}", i) for i in range(40)], "norm string, ord long")
    lines = spark.createDataFrame([(f"http://a.x/{i}", f"http://a.x/{j}", "body", 40 * i + j) for i in range(40) for j in (i + 1, i // 2) if j < 40], "s string, t string, placement string, ord long")
    got = tree.bfs_tree(chain, lines, "http://a.x/0")
    assert sorted((r["level"], r["parent"]) for r in got.where("level > 0").collect()) == [(i, f"http://a.x/{i - 1}") for i in range(1, 40)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_lanes_take_turns():
    delay, lanes = 2.0, 4
    turns = sorted(fetch.next_turn(100.3 + k * 1.7, lane, lanes, delay) for lane in range(lanes) for k in range(9))
    distinct = sorted({round(t, 6) for t in turns})
    assert min(b - a for a, b in zip(distinct, distinct[1:], strict=False)) >= delay - 1e-9
    for lane in range(lanes):
        for now in (0.0, 0.1, 7.9, 8.0, 8.1, 1e9 + 0.37):
            t = fetch.next_turn(now, lane, lanes, delay)
            assert now <= t < now + lanes * delay + 1e-6 and abs((t - lane * delay) / (lanes * delay) - round((t - lane * delay) / (lanes * delay))) < 1e-6


def test_one_host_in_many_tasks_keeps_its_rate(spark):
    site = Site()
    frontier = spark.createDataFrame([(f"{site.url}/{i}", 0, i) for i in range(24)], "url string, depth int, ord long")
    rows = fetch.http_fetch(frontier, fetch.FetchSettings(delay=0.1, retries=0), lanes=4)
    assert rows.rdd.getNumPartitions() > 1
    assert {r["status_code"] for r in rows.collect()} == {200}
    at = sorted(t for method, _, t in site.asked if method == "HEAD")
    assert len(at) == 24
    for i in range(len(at) - 4):  # a request may be late, never early
        assert at[i + 4] - at[i] >= 0.25
    site.shutdown()


def test_images_are_probed_once_across_crawls(spark, tmp_path):
    site = Site()
    images = lambda *rows: spark.createDataFrame([(u, p, f"{site.url}/{s}" if s else "data:x") for u, p, s in rows], "url string, pos int, src string")
    first = images(("p1", 0, "a.png"), ("p1", 1, "bad.png"), ("p2", 0, "a.png"), ("p2", 1, ""), ("p2", 2, "c.png"), ("p2", 3, "d.png"))
    path = f"file://{tmp_path}/images"
    status = lambda df: {r["src"].rsplit("/", 1)[1]: r["status"] for r in df.collect()}
    assert status(fetch.image_statuses(first, path, most=2)) == {"a.png": 200, "bad.png": 404, "c.png": 200}
    assert sorted(p for _, p, _ in site.asked) == ["/a.png", "/bad.png", "/c.png"]
    found = fetch.image_statuses(first, path, most=2)
    assert status(found) == {"a.png": 200, "bad.png": 404, "c.png": 200, "d.png": 200}
    assert status(fetch.image_statuses(images(("p9", 0, "bad.png"), ("p9", 1, "e.png")), path)) == {"bad.png": 404, "e.png": 200}
    assert sorted(p for _, p, _ in site.asked) == ["/a.png", "/bad.png", "/c.png", "/d.png", "/e.png"]
    assert {m for m, *_ in site.asked} == {"HEAD"}
    broken = linkgraph.broken_images(first, found)
    assert [(r["url"], r["broken_images"][0]["status"]) for r in broken.collect()] == [("p1", 404)]
    site.shutdown()
    site.server_close()
    assert fetch.head_status(site.url + "/gone", 0.5) == 0


def test_ratings_as_of_a_time(spark):
    t0 = datetime(2024, 1, 1, tzinfo=UTC)
    at = lambda s: t0 + timedelta(seconds=s)
    history = spark.createDataFrame([("a.x", at(0), 1.26), ("a.x", at(200), 2.0), ("a.x", at(900), 3.0), ("b.x", at(0), 5.0)], "domain string, fetched_at timestamp, rating double")
    asked = [("http://www.a.x/p", -1, None, "missing"), ("a.x", 0, 1.3, "cached"), ("a.x", 199, 1.3, "cached"), ("a.x", 200, 2.0, "cached"), ("a.x", 499, 2.0, "cached"), ("a.x", 500, None, "expired"), ("a.x", 950, 3.0, "cached"), ("b.x", 301, None, "expired"), ("c.x", 5, None, "missing"), ("", 5, None, "invalid")]
    got = views.domain_ratings(spark.createDataFrame([(t, at(s)) for t, s, *_ in asked], "target string, at timestamp"), history).collect()
    assert sorted((r["target"], r["at"].replace(tzinfo=UTC), r["domain_rating"], r["state"]) for r in got) == sorted((t, at(s), v, st) for t, s, v, st in asked)


def test_only_open_domains_are_asked(spark, tmp_path):
    calls = []

    def ask(domains):
        calls.append(sorted(r["domain"] for r in domains.collect()))
        return domains.withColumn("rating", F.when(F.col("domain") != "down.x", F.length("domain") + F.lit(0.25 * len(calls))))

    targets = spark.createDataFrame([("a.x",), ("http://a.x/1",), ("www.bb.x",), ("down.x",), ("",)], "target string")
    path, now = f"file://{tmp_path}/ratings", datetime(2024, 1, 1)
    look = lambda s: {r["target"]: (r["domain_rating"], r["cached"]) for r in views.look_up_ratings(targets, path, ask, now + timedelta(seconds=s)).collect()}
    assert look(0) == {"a.x": (3.3, False), "http://a.x/1": (3.3, False), "www.bb.x": (4.3, False), "down.x": (None, False), "": (None, False)}
    assert look(299)["a.x"] == (3.3, True)
    assert look(300)["a.x"] == (3.8, False) or look(300)["a.x"][1]
    assert calls[:2] == [["a.x", "bb.x", "down.x"], ["down.x"]] and calls[2] == ["a.x", "bb.x", "down.x"]


def test_sources_beyond_the_list_are_counted(spark):
    pages = spark.createDataFrame([("t",), ("u",)], "url string")
    links = spark.createDataFrame(pd.DataFrame({"source_url": [f"s{i % 40}" for i in range(80)], "target_url": "t", "ord": range(80)}))
    got = {r["url"]: r for r in linkgraph.linked_from(pages, links, most=7).collect()}
    assert got["t"]["linked_from"] == [f"s{i}" for i in range(7)] and got["t"]["n_sources"] == 40 and got["u"]["n_sources"] == 0
    assert linkgraph.link_sources(links).count() == 40
