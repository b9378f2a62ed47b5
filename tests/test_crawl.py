import zipfile

import pytest
from pyspark.sql import functions as F

from pagequill.functions import shared
from pagequill.operators import filters, setchecks
from pagequill.sources import fetch, html, store
from pagequill.streaming import live


def site(spark):
    link = lambda *hrefs: "<html><title>t</title><body>" + "".join(f'<a href="{h}">x</a>' for h in hrefs) + "</body></html>"
    rows = [("http://a.x/", link("/1", "/2", "/1#part")), ("http://a.x/1", link("/3")), ("http://a.x/2", link("/3", "/4", "/")), ("http://a.x/3", link("/5")), ("http://a.x/4", "")]
    return spark.createDataFrame(rows, "url string, html string")


def test_crawl_numbers_pages_without_gaps(spark):
    pages, links = fetch.crawl(spark.createDataFrame([("http://a.x/",)], "url string"), filters.CrawlScope("http://a.x/", max_depth=3), fetch.table_fetch(site(spark)))
    got = [(r["url"], r["depth"], r["status_code"]) for r in pages.orderBy("ord").collect()]
    assert got == [("http://a.x/", 0, 200), ("http://a.x/1", 1, 200), ("http://a.x/2", 1, 200), ("http://a.x/3", 2, 200), ("http://a.x/4", 2, 200), ("http://a.x/5", 3, 404)]
    assert [r["ord"] for r in pages.orderBy("ord").collect()] == list(range(6))
    assert links.select("ord").distinct().count() == links.count() == 7


def test_crawl_pauses_and_resumes(spark, tmp_path):
    seeds, scope, state, asked = spark.createDataFrame([("http://a.x/",)], "url string"), filters.CrawlScope("http://a.x/", max_depth=3), f"file://{tmp_path}/state", []
    get = fetch.table_fetch(site(spark))

    def counted(frontier):
        asked.extend(r["url"] for r in frontier.collect())
        return get(frontier)

    first, _ = fetch.crawl(seeds, scope, counted, state=state, stop=lambda: len(asked) >= 3)
    assert {r["url"] for r in first.collect()} == {"http://a.x/", "http://a.x/1", "http://a.x/2"}
    whole, _ = fetch.crawl(seeds, scope, counted, state=state)
    assert sorted(asked) == sorted(r["url"] for r in whole.collect()) and len(asked) == 6


def test_crawl_pauses_within_a_level(spark, tmp_path):
    """Parts of two URLs; a pause after each part, and a restart that asks for nothing twice."""
    html = [("http://a.x/", "".join(f'<a href="/{i}">x</a>' for i in range(5))), *[(f"http://a.x/{i}", f'<a href="/{i}/z">x</a>') for i in range(5)]]
    site_rows = spark.createDataFrame(html, "url string, html string")
    seeds, scope, state, asked = spark.createDataFrame([("http://a.x/",)], "url string"), filters.CrawlScope("http://a.x/", max_depth=2), f"file://{tmp_path}/state", []
    get = fetch.table_fetch(site_rows)

    def counted(frontier):
        asked.append(sorted(r["url"] for r in frontier.collect()))
        return get(frontier)

    seen = []
    for _ in range(12):
        pages, links = fetch.crawl(seeds, scope, counted, state=state, stop=lambda: True, part_urls=2)
        seen.append(pages.count())
    whole, _ = fetch.crawl(seeds, scope, get, part_urls=2)
    assert seen[:7] == [1, 3, 5, 6, 8, 10, 11] and seen[-1] == 11
    assert sorted(sum(asked, [])) == sorted(r["url"] for r in whole.collect()) and max(map(len, asked)) == 2
    assert sorted((r["ord"], r["url"]) for r in pages.collect()) == sorted((r["ord"], r["url"]) for r in whole.collect())
    assert links.count() == 10


def test_long_body_is_an_error_not_a_cut(spark, monkeypatch):
    import io
    import urllib.request

    class Answer(io.BytesIO):
        status, url = 200, "http://a.x/"

        class headers:  # noqa: N801
            get = staticmethod(lambda name: {"Content-Type": "text/html"}.get(name))
            get_content_charset = staticmethod(lambda: "utf-8")

    opener = type("O", (), {"open": staticmethod(lambda *a, **k: Answer(b"x" * 11))})
    monkeypatch.setattr(urllib.request, "build_opener", lambda *a: opener)
    assert fetch.fetch_one("http://a.x/", 0, fetch.FetchSettings(max_bytes=10, retries=0))["error"] == "file_too_large"
    assert fetch.fetch_one("http://a.x/", 0, fetch.FetchSettings(max_bytes=11, retries=0))["size"] == 11


def test_numbered(spark):
    rows = shared.numbered(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")), ["k"], "t", 5)
    assert rows.where("ord <> k + 5").count() == 0
    assert shared.numbered(spark.range(0), ["id"], "t").count() == 0


def test_hot_groups_join(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = shared.join_by_group(rows, groups.where("k <> 1"), "k", "n", 3000)
    assert got.count() == 3000 and {r["n"] for r in got.where("k = 0").collect()} == {1000} and got.where("n is null").count() == 1


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([("u", 1, "a<b"), ("v", None, "x")], "url string, n int, text string")
    store.export_xlsx({"URLs": rows, "Issues & co": rows.limit(0)}, f"{tmp_path}/x.xlsx")
    with zipfile.ZipFile(f"{tmp_path}/x.xlsx") as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
        assert "a&lt;b" in sheet and sheet.count("<row>") == 3 and "<v>1</v>" in sheet
        assert "Issues &amp; co" in z.read("xl/workbook.xml").decode()
    with pytest.raises(ValueError):
        store.export_xlsx({"URLs": rows}, f"{tmp_path}/y.xlsx", most=1)
    with pytest.raises(ValueError):
        store.json_envelope(rows, ["url"], "today", most=1)
    assert '"total_urls": 2' in store.json_envelope(rows, ["url"], "today")


def test_settings(spark, tmp_path):
    kept = store.SettingsStore(spark, f"file://{tmp_path}/settings")
    put = lambda *rows: kept.save(spark.createDataFrame(list(rows), "user_id long, settings string"))
    assert kept.all().count() == 0 and kept.get(1, {"a": 1}) == {"a": 1}
    put((1, '{"a": 2}'), (2, "{}"))
    put((1, '{"a": 3}'))
    assert kept.get(1, {"a": 1, "b": 5}) == {"a": 3, "b": 5}
    put((1, None))
    assert kept.get(1, {"a": 1}) == {"a": 1} and kept.all().count() == 1


def test_finish_crawl(spark):
    pages, links = fetch.crawl(spark.createDataFrame([("http://a.x/",)], "url string"), filters.CrawlScope("http://a.x/", max_depth=3), fetch.table_fetch(site(spark)))
    listed = spark.createDataFrame([(0, "http://a.x/1"), (1, "http://a.x/lost")], "ord long, url string")
    done, linked, issues = setchecks.finish_crawl(pages.withColumn("is_internal", F.lit(True)), links, listed)
    assert {r["url"]: r["linked_from"] for r in done.collect()}["http://a.x/3"] == ["http://a.x/1", "http://a.x/2"]
    assert {r["target_url"]: r["target_status"] for r in linked.collect()}["http://a.x/5"] == 404
    assert ("http://a.x/lost", "In Sitemap, Not Crawled") in {(r["url"], r["issue"]) for r in issues.collect()}


def run_stream(spark, rows, path, build, mode="append"):
    """rows, written as two files in time order, through build as a stream; what it has put out."""
    rows.orderBy(rows.columns[0]).coalesce(1).write.option("maxRecordsPerFile", max(rows.count() // 2, 1)).parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    name = f"out{abs(hash(str(path)))}"
    build(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}/check").start().awaitTermination()
    return spark.table(name)


def test_streams_equal_batch(spark, tmp_path):
    events = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id as int)) ts, if(id % 2 = 0, 'a', 'b') event_type, cast(id as double) value, concat('u', id % 10) url from range(100)")
    got = run_stream(spark, events, tmp_path / "w", live.windowed_counts, "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, live.windowed_counts(events).collect()))
    got = run_stream(spark, events, tmp_path / "n", lambda s: live.new_urls(s.select("ts", "url"), "ts", "3 hours"))
    assert sorted(r["url"] for r in got.collect()) == sorted(f"u{i}" for i in range(10))
    extracted = html.extract_pages(site(spark).withColumn("ord", F.length("url").cast("long"))).select("ord", "url", *[c for c in ("title",)])
    statuses = spark.createDataFrame([("http://a.x/1", 200, 1)], "url string, status_code int, ord long")
    links = extracted.select(F.col("url").alias("target_url"), F.lit(None).cast("int").alias("target_status"))
    got = run_stream(spark, links, tmp_path / "l", lambda s: live.late_status(s, statuses))
    assert {r["target_url"]: r["target_status"] for r in got.collect()}["http://a.x/1"] == 200 and got.count() == 5


def test_live_issues_stream_equals_batch(spark, tmp_path):
    from pagequill.plans import fixtures

    rows = fixtures.crawl_pages(spark, "/root/testdata/sf0.001")
    got = run_stream(spark, rows, tmp_path, live.live_issues)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, live.live_issues(rows).collect()))
