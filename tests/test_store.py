import pytest
from pyspark.sql import functions as F

from pagequill.operators import linkgraph
from pagequill.sources import store
from pagequill.streaming import live


def rows(spark, first, n, **more):
    return spark.range(first, first + n).select(F.col("id").alias("ord"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), *[F.lit(v).alias(k) for k, v in more.items()])


def ids(df):
    return sorted(r["ord"] for r in df.collect())


def stream_of(spark, path, df, files=1):
    df.repartitionByRange(files, "ord").write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_saved_and_streamed_crawls_side_by_side(spark, tmp_path):
    s = store.CrawlStore(spark, f"file://{tmp_path}/store")
    s.save("pages", rows(spark, 0, 10), 1)
    live.save_stream(stream_of(spark, f"{tmp_path}/in", rows(spark, 100, 20), 3), s, "pages", 2, f"{tmp_path}/check", once=True).awaitTermination()
    s.save("pages", rows(spark, 10, 5, title="t"), 1)
    s.save("pages", rows(spark, 300, 1), 2)
    assert ids(s.load("pages", 1)) == [*range(15)] and ids(s.load("pages", 2)) == [*range(100, 120), 300]
    assert s.load("pages", 1).where("title is null").count() == 10
    assert s.load("pages", 1).unionByName(s.load("pages", 2), allowMissingColumns=True).count() == 36
    assert s.version("pages", 2) >= 4 and ids(s.load("pages", 1, version=1)) == [*range(10)]
    s.delete(1)
    assert ids(s.load("pages", 2)) == [*range(100, 120), 300]
    with pytest.raises(LookupError):
        s.load("pages", 1)


def test_stream_restarts_and_batches_are_committed_once(spark, tmp_path):
    s = store.CrawlStore(spark, f"file://{tmp_path}/store")
    for first in (0, 10):
        live.save_stream(stream_of(spark, f"{tmp_path}/in", rows(spark, first, 10)), s, "pages", 1, f"{tmp_path}/check", once=True).awaitTermination()
    assert ids(s.load("pages", 1)) == [*range(20)]
    before = s.version("pages", 1)
    again = s.log("pages", 1).select("batch", "version").first()
    assert s.save("pages", rows(spark, 0, 10), 1, batch=again["batch"]) == again["version"] and s.version("pages", 1) == before
    assert ids(s.load("pages", 1)) == [*range(20)]


def test_a_stopped_save_is_not_read(spark, tmp_path, monkeypatch):
    s = store.CrawlStore(spark, f"file://{tmp_path}/store")
    s.save("pages", rows(spark, 0, 3), 1, "a")

    def stop(*a, **k):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(store.CrawlStore, "_commit", stop)
        with pytest.raises(RuntimeError):
            s.save("pages", rows(spark, 3, 3), 1, "b")
    assert ids(s.load("pages", 1)) == [0, 1, 2]
    s.save("pages", rows(spark, 3, 3), 1, "b")
    assert ids(s.load("pages", 1)) == [*range(6)]


def test_changes_give_each_row_once(spark, tmp_path):
    s = store.CrawlStore(spark, f"file://{tmp_path}/store")
    assert s.changes("issues", 1) == (None, 0, True)
    s.save("issues", rows(spark, 0, 0), 1)
    s.save("issues", rows(spark, 0, 4), 1)
    got, cursor, full = s.changes("issues", 1)
    assert ids(got) == [0, 1, 2, 3] and full
    assert s.changes("issues", 1, cursor) == (None, cursor, False)
    seen = []
    for k in range(3):
        s.save("issues", rows(spark, 4 + k, 1), 1)
        got, cursor, full = s.changes("issues", 1, cursor)
        seen += ids(got.where("ord <> 5"))  # a filter moves no cursor
        assert not full
    assert seen == [4, 6]
    s.refresh("issues", 1)
    got, cursor, full = s.changes("issues", 1, cursor)
    assert full and ids(got) == [*range(7)]
    assert s.changes("issues", 1, cursor) == (None, cursor, False)


def test_pages_by_key_read_few_files(spark, tmp_path):
    s = store.CrawlStore(spark, f"file://{tmp_path}/store")
    for first in (0, 500):
        s.save("pages", rows(spark, first, 500).repartition(5), 1)
    s.save("pages", rows(spark, 0, 20).withColumn("ord", F.col("ord") * 100 + 5000), 1)
    s.save("pages", rows(spark, 5001, 20).withColumn("ord", F.when(F.col("ord") < 5015, F.col("ord"))), 1)
    want = sorted([*range(1000), *range(5000, 7000, 100), *range(5001, 5015)])
    got, after = [], None
    while True:
        page = s.page("pages", 1, after, 77)
        assert len(page.inputFiles()) <= 4
        part = [r["ord"] for r in page.collect()]
        if not part:
            break
        got, after = got + part, part[-1]
    assert got == want
    assert [r["ord"] for r in s.page("pages", 1, 990, 77).collect()] == [*range(991, 1000), *want[1000:]]
    assert len(s.page("pages", 1, 900, 10).inputFiles()) < s.log("pages", 1).count()


def test_parsed_json_columns(spark):
    df = spark.createDataFrame([(1, '["a", "b"]', '{"k": "v"}'), (2, '["a", ', "x"), (3, None, None), (4, '{"a": 1}', "[1]"), (5, "", "")], "id int, h2 string, tags string")
    got = {r["id"]: (r["h2"], r["tags"]) for r in store.parsed(df, {"h2": "array<string>", "tags": "map<string,string>"}).collect()}
    assert got == {1: (["a", "b"], {"k": "v"}), 2: ([], {}), 3: ([], {}), 4: ([], {}), 5: ([], {})}


def land(spark, path, links, pages, turns):
    """Links and pages that land in turns, through late_status with a restart after each; the last state of each link."""
    for kind, part in turns:
        (links if kind == "links" else pages).where(part).coalesce(1).write.mode("append").parquet(f"{path}/{kind}")
        for other, df in (("links", links), ("pages", pages)):
            df.limit(0).write.mode("append").parquet(f"{path}/{other}")
        stream = lambda name, df: spark.readStream.schema(df.schema).parquet(f"{path}/{name}")
        live.save_patches(live.late_status(stream("links", links), stream("pages", pages), salts=3), f"{path}/out", f"{path}/check", once=True).awaitTermination()
    return {(r["source_url"], r["target_url"]): r["target_status"] for r in live.patched_links(spark, f"{path}/out").collect()}


def test_late_status_of_each_page_in_any_order(spark, tmp_path):
    """Two pages of one URL; one of them lands late, one changes its status."""
    links = spark.createDataFrame([(f"s{i}", f"t{i % 3}", i, 418) for i in range(9)], "source_url string, target_url string, ord long, target_status int")
    first = spark.createDataFrame([("t0", 200, 1), ("t1", 404, 2), ("t1", 301, 3)], "url string, status_code int, ord long")
    later = spark.createDataFrame([("t1", 200, 2), ("t0", 503, 9)], "url string, status_code int, ord long")
    now = spark.createDataFrame([("t0", 200, 1), ("t0", 503, 9), ("t1", 200, 2), ("t1", 301, 3)], "url string, status_code int, ord long")
    want = sorted((r["source_url"], r["target_status"]) for r in linkgraph.resolve_status(links, now, each_page=True).collect())
    assert len(want) == 15
    turns = [[("links", links)], [("pages", first)], [("links", links.withColumn("ord", F.col("ord") + 100))], [("pages", later)]]
    for order in (turns, turns[1:] + turns[:1]):
        path = f"{tmp_path}/{order is turns}"
        for turn in order:
            for name, df in (("links", links.limit(0)), ("pages", first.limit(0)), *turn):
                df.coalesce(1).write.mode("append").parquet(f"{path}/{name}")
            stream = lambda name, df: spark.readStream.schema(df.schema).parquet(f"{path}/{name}")  # noqa: B023, E731
            live.save_patches(live.late_status(stream("links", links), stream("pages", first), salts=2, each_page=True), f"{path}/out", f"{path}/check", once=True).awaitTermination()
        got = live.patched_links(spark, f"{path}/out")
        for part in ("ord < 100", "ord >= 100"):
            assert sorted((r["source_url"], r["target_status"]) for r in got.where(part).collect()) == want


def test_late_status_in_any_order(spark, tmp_path):
    links = spark.createDataFrame([(f"s{i}", f"t{i % 4}", i, None if i % 3 else 418) for i in range(24)], "source_url string, target_url string, ord long, target_status int")
    pages = spark.createDataFrame([("t0", 200, 1), ("t1", 404, 2), ("t2", 301, 3), ("t2", 200, 9)], "url string, status_code int, ord long")
    want = {(r["source_url"], r["target_url"]): r["target_status"] for r in linkgraph.resolve_status(links, pages).collect()}
    assert {r["target_status"] for r in live.late_status(links, pages).collect()} == {200, 404, 418, None}
    orders = [
        [("links", "true"), ("pages", "true")],
        [("pages", "true"), ("links", "true")],
        [("links", "ord < 10"), ("pages", "ord < 9"), ("links", "ord >= 10"), ("pages", "ord = 9")],
    ]
    for k, turns in enumerate(orders):
        assert land(spark, f"{tmp_path}/{k}", links, pages, turns) == want
