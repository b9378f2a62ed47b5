"""Queries against their SQL on pages that share URLs."""

import math
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__

QUERIES = ["a4_j4_group_issues", "a5_severity_counts", "g6_t7_authority_parents", "s5_f4_first_images", "s5_broken_images", "x11_x12_placed_links", "x11_x13_links", "j1_link_status", "i4_late_status"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """120 pages; every eighth has the URL of a page before it, and other facts."""
    where = str(tmp_path_factory.mktemp("repeated"))
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("page_id < 120")
    first = rows.select((F.col("page_id") + 28).alias("page_id"), F.col("url").alias("before"))
    rows = rows.join(first, "page_id", "left").withColumn("url", F.when(F.col("page_id") % 8 == 3, F.coalesce("before", "url")).otherwise(F.col("url"))).drop("before")
    rows.coalesce(1).write.parquet(f"{where}/pages.parquet")
    return where


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return float(value) if hasattr(value, "as_tuple") else value


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, tables, name):
    found = __spark_entry__.queries()[name](spark, tables)
    got = Counter(tuple(map(plain, r)) for r in found.collect())
    con = duckdb.connect()
    for t in os.listdir(tables):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS FROM '{tables}/{t}/*.parquet'")
    cur = con.execute(__spark_entry__.oracle_sql()[name])
    at = [[c[0] for c in cur.description].index(c) for c in found.columns]
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in cur.fetchall()) and got
