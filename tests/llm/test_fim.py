import hashlib
import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from pagequill.llm import fim

SCHEMA = "doc_id long, text string, n string, form string, output string"


def plain(i, text, seed=7, rate=100, spm=50):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    r = random.Random(1)
    parts = ["a\n", "\n", "é东🎈\n", "<", "<P", "P>", "S>x\n", "\r\n", "\x00\n", "end", "   ", "x" * 50 + "\n", "<M\n", "<<\n"]
    out = [None, "", "\n", "x", "a<P>b", "<M>", "\n\n\n", "no end\nhere", "<S\n>", "word " * 300_000, "line\n" * 40_000]
    return out + ["".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(300)]


def test_equals_the_plain_form_and_round_trip(spark):
    rows = [(None if i == 20 else i % 250, t) for i, t in enumerate(texts())]
    rows += [rows[30]] * 3
    df = spark.createDataFrame([(i, t, "k", "l", "m") for i, t in rows], SCHEMA).repartition(3)
    for kw in ({}, {"slice_bytes": 100}, {"fim_percent": 40, "spm_percent": 20, "seed": 9}):
        args = {"seed": kw.get("seed", 7), "rate": kw.get("fim_percent", 100), "spm": kw.get("spm_percent", 50)}
        got = fim.fill_in_middle(df, **kw).collect()
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want = [(i, *plain(i, t, **args), sha(plain(i, t, **args)[4]), sha(t or "")) for i, t in rows]
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_empty_table_and_string_ids(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert fim.fill_in_middle(empty).count() == 0
    got = fim.fill_in_middle(spark.createDataFrame([("a b", "x\ny\nz")], "key string, body string"), "key", "body").first()
    assert got["key"] == "a b" and tuple(got)[1:6] == plain("a b", "x\ny\nz")


def test_slices_are_bounded():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["x" * 10, None, "", "y" * 100, "z", "z"])], ["id", "text"])
    parts = list(fim.slices(batch, 12))
    assert [p.num_rows for p in parts] == [3, 1, 2]
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert list(fim.slices(batch.slice(0, 0), 12)) == []


def test_batches_pass_whole(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("l\n"), F.col("id").cast("string")).alias("text")).coalesce(1)
    assert fim.fill_in_middle(df).agg(F.sum("n"), F.count("*")).first()[:] == (10_000, 5000)
