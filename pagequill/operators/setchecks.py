"""Checks across pages: redirects, duplicate values, sitemap, fuzzy duplicates."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequill.functions.scalars import missing, missing_list
from pagequill.functions.shared import join_by_group, materialize
from pagequill.functions.urls import normalize_url
from pagequill.model import ISSUE_COLUMNS
from pagequill.operators.filters import excluded

#: Fixed weights of the fuzzy score.
WEIGHTS = {"title": 0.35, "meta_description": 0.35, "h1": 0.20, "words": 0.10}
SAMPLES = 3


def _rows(df: DataFrame, kind: str | Column, category: str, issue: str | Column, details: Column | str) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select("url", lit(kind).alias("type"), F.lit(category).alias("category"), lit(issue).alias("issue"), lit(details).alias("details"))


def redirect_issues(pages: DataFrame, exclusions: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Loops (a normal form twice among hops and final URL), chains of two hops or more, and redirects that end in an error.

    Keys are aggressive normal forms; with strict they are conservative ones, so
    that www and slash redirects are no loops. Normal forms are computed per hop
    once, and all else is array code on the row.
    """
    rows = pages.where(~excluded(F.col("url"), exclusions or []))
    failed = (F.coalesce("status_code", F.lit(0)) == 0) & (F.col("error_type") == "too_many_redirects")
    loops = _rows(rows.where(failed), "error", "Redirects", "Redirect Loop", F.coalesce(F.nullif(F.col("error"), F.lit("")), F.lit("URL redirects in a loop (too many redirects)")))
    rows = rows.where(~F.coalesce(failed, F.lit(False)) & (F.size("redirects") > 0))
    path = F.concat(F.transform("redirects", lambda r: r["url"]), F.array(F.coalesce(F.nullif(F.col("final_url"), F.lit("")), F.col("url"))))
    hops = rows.select("ord", "url", "status_code", F.size("redirects").alias("hops"), path.alias("path"))
    keys = hops.select("ord", F.posexplode("path").alias("pos", "u")).withColumn("k", normalize_url(F.col("u"), not strict))
    loop = keys.groupBy("ord").agg((F.count_distinct("k") < F.count("*")).alias("loop"))
    hops = hops.join(loop, "ord").withColumn("shown", F.array_join("path", " -> "))
    looped = _rows(hops.where("loop"), "error", "Redirects", "Redirect Loop", F.concat(F.lit("Redirect sequence revisits a URL: "), "shown"))
    chains = _rows(hops.where("not loop and hops >= 2"), "warning", "Redirects", "Redirect Chain", F.concat(F.col("hops").cast("string"), F.lit(" hops: "), "shown"))
    errors = _rows(hops.where("status_code >= 400"), "error", "Redirects", "Redirect to Error Page", F.concat(F.lit("Redirect ends in HTTP "), F.col("status_code").cast("string"), F.lit(": "), "shown"))
    return loops.unionByName(looped).unionByName(chains).unionByName(errors)


def shared_values(pages: DataFrame, exclusions: list[str] | None = None) -> DataFrame:
    """(ord, url, field, value, key) of the titles, descriptions and h1 that can be duplicates; equal keys are equal values."""
    ok = F.coalesce("is_internal", F.lit(True)) & (F.col("status_code") == 200) & (F.coalesce(F.size("redirects"), F.lit(0)) <= 0) & ~excluded(F.col("url"), exclusions or [])
    fields = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("value")) for n in ("title", "meta_description", "h1")])
    rows = pages.where(ok).select("ord", "url", F.explode(fields).alias("f")).select("ord", "url", "f.*")
    return rows.withColumn("key", F.lower(F.trim(F.regexp_replace("value", r"\s+", " ")))).where(~missing("key"))


def duplicate_issues(pages: DataFrame, exclusions: list[str] | None = None) -> DataFrame:
    """One issue for each member of a group that shares a title, description or h1; no value, however common, meets in one task."""
    rows = materialize(shared_values(pages, exclusions), "shared-values")
    # A rank limit is applied in each task before rows are shuffled, so a hot value sends a few of them.
    place = F.row_number().over(Window.partitionBy("field", "key").orderBy("ord", "url"))
    firsts = rows.withColumn("place", place).where(F.col("place") <= SAMPLES + 1)
    firsts = firsts.groupBy("field", "key").agg(F.sort_array(F.collect_list(F.struct("ord", "url", "value"))).alias("s"))
    groups = rows.groupBy("field", "key").agg(F.count("*").alias("n")).where("n >= 2").join(firsts, ["field", "key"])
    names = F.create_map(*[F.lit(x) for x in ("title", "Duplicate Title", "meta_description", "Duplicate Meta Description", "h1", "Duplicate H1")])
    groups = groups.withColumn("__fk", F.concat_ws("\x00", "field", "key")).drop("field", "key")
    joined = join_by_group(rows.withColumn("__fk", F.concat_ws("\x00", "field", "key")), groups, "__fk", "n", rows.count()).where(F.col("n").isNotNull())
    others = F.slice(F.transform(F.filter("s", lambda x: x["url"] != F.col("url")), lambda x: x["url"]), 1, SAMPLES)
    shown = F.trim(F.get("s", F.lit(0))["value"])
    shown = F.when(F.length(shown) > 60, F.concat(F.substring(shown, 1, 57), F.lit("..."))).otherwise(shown)
    details = F.concat(F.lit('"'), shown, F.lit('" is shared by '), F.col("n").cast("string"), F.lit(" pages (e.g. "), F.array_join(others, ", "), F.lit(")"))
    return _rows(joined, "warning", "Duplication", F.element_at(names, F.col("field")), details)


def sitemap_issues(pages: DataFrame, sitemap: DataFrame, exclusions: list[str] | None = None) -> DataFrame:
    """Sitemap against crawl, on aggressive normal forms, by one full outer join of distinct keys."""
    first = lambda df, *c: df.withColumn("k", normalize_url(F.col("url"), True)).groupBy("k").agg(F.min_by(F.struct("url", *c), "ord").alias("r")).select("k", "r.*")
    listed = first(sitemap).withColumnRenamed("url", "listed_url")
    crawled = first(pages, "status_code", "is_internal", "content_type", "redirects")
    both = crawled.join(listed, "k", "full_outer")
    missing_page = _rows(both.where("url is null").select(F.col("listed_url").alias("url")), "warning", "Sitemap", "In Sitemap, Not Crawled", "URL is listed in the XML sitemap but was not crawled (blocked by robots.txt, filtered, or unreachable)")
    bad = both.where("url is not null and listed_url is not null and status_code <> 200").select(F.col("listed_url").alias("url"), "status_code")
    bad = _rows(bad, "error", "Sitemap", "Sitemap URL Not Indexable", F.concat(F.lit("Sitemap URL returned HTTP "), F.col("status_code").cast("string")))
    html = F.coalesce(F.col("content_type"), F.lit("")).contains("text/html")
    extra = both.where(F.col("listed_url").isNull() & F.coalesce("is_internal", F.lit(True)) & (F.col("status_code") == 200) & missing_list("redirects") & html & ~excluded(F.col("url"), exclusions or []))
    extra = _rows(extra, "info", "Sitemap", "Crawled, Not in Sitemap", "Page was discovered by crawling but is missing from the XML sitemap")
    return missing_page.unionByName(bad).unionByName(extra)


def _letters(c: Column) -> Column:
    """Counts of a-z, digits together, space and the rest: 29 numbers."""
    low = F.lower(c)
    kinds = [*map(chr, range(97, 123)), " "]
    counts = [F.length(low) - F.length(F.replace(low, F.lit(k), F.lit(""))) for k in kinds]
    return F.array(*counts, F.length(low) - F.reduce(F.array(*counts), F.lit(0), lambda a, x: a + x))


#: Rows of a cell: two cells meet in one task, in slices of SLICE rows against all of the other.
CELL, SLICE = 1024, 256


def _positions(text: str) -> dict[str, int]:
    """The positions of each letter as bits."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def _common_subsequence(at: dict[str, int], length: int, other: str) -> int:
    """Length of the longest common subsequence of a text, given by its positions, and another; what difflib matches is one."""
    full = (1 << length) - 1
    v = full
    for c in other:
        u = v & at.get(c, 0)
        v = (v + u | v - u) & full
    return length - v.bit_count()


def _score_pairs(a: pd.DataFrame, b: pd.DataFrame | None, threshold: float) -> pd.DataFrame:
    """(url_a, url_b, similarity) of the pairs of a and b, or of a alone, that difflib scores to the end; the first of a pair is the first by ord.

    A pair is left as soon as a bound of its score is under the threshold: by
    lengths, by letters, by common subsequences, by the ratios known so far.
    """
    alone, b = b is None, a if b is None else b
    fields, least = (("t", "title"), ("d", "meta_description"), ("h", "h1")), threshold - 1e-9
    counts = {f: (np.stack(a[f"l{f}"].to_list()).astype("int32"), np.stack(b[f"l{f}"].to_list()).astype("int32")) for f, _ in fields}
    lengths = {f: (a[f"n{f}"].to_numpy(), b[f"n{f}"].to_numpy()) for f, _ in fields}
    texts = {f: (a[f].to_list(), b[f].to_list()) for f, _ in fields}
    ords, urls, seen = (a.ord.to_list(), b.ord.to_list()), (a.url.to_list(), b.url.to_list()), (a.w.to_numpy(), b.w.to_numpy())

    def part(common: np.ndarray, total: np.ndarray) -> np.ndarray:
        return 2 * common / np.maximum(total, 1)

    def words(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.where((x > 0) & (y > 0), np.minimum(x, y) / np.maximum(np.maximum(x, y), 1), 0.0)

    positions, bounds, ratios, matcher, out = {}, {}, {}, difflib.SequenceMatcher(None), []

    def bound(x: str, y: str) -> float:
        if (x, y) not in bounds:
            if len(bounds) > 1 << 18:
                bounds.clear()
            if x not in positions:
                positions[x] = _positions(x)
            bounds[x, y] = 1.0 if x == y else 2 * _common_subsequence(positions[x], len(x), y) / (len(x) + len(y))
        return bounds[x, y]

    def ratio(x: str, y: str) -> float:
        if not x or not y:
            return 0.0
        if x == y:
            return 1.0
        if (x, y) not in ratios:
            if len(ratios) > 1 << 18:
                ratios.clear()
            if matcher.b != y:
                matcher.set_seq2(y)
            matcher.set_seq1(x)
            ratios[x, y] = matcher.ratio()
        return ratios[x, y]

    for at in range(0, len(a), SLICE):
        i, j = np.indices((min(SLICE, len(a) - at), len(b))).reshape(2, -1)
        i = i + at
        if alone:
            i, j = i[i < j], j[i < j]
        share = WEIGHTS["words"] * words(seen[0][i], seen[1][j])
        parts = {f: part(np.minimum(n[0][i], n[1][j]), n[0][i] + n[1][j]) for f, n in lengths.items()}
        total = lambda: share + sum(WEIGHTS[name] * parts[f] for f, name in fields)  # noqa: B023, E731
        for f in ("", "t", "h", "d"):
            if f:
                parts[f] = part(np.minimum(counts[f][0][i], counts[f][1][j]).sum(1), lengths[f][0][i] + lengths[f][1][j])
            keep = total() >= least
            i, j, share, parts = i[keep], j[keep], share[keep], {k: v[keep] for k, v in parts.items()}
        order = np.lexsort((i, j))  # difflib prepares a pair's second text, once for all pairs in a row that have it
        for i, j, share, *ups in zip(i[order].tolist(), j[order].tolist(), share[order].tolist(), *(parts[f][order].tolist() for f, _ in fields), strict=True):  # noqa: B020, PLW2901
            up, first = dict(zip("tdh", ups, strict=True)), (ords[0][i], urls[0][i]) < (ords[1][j], urls[1][j])
            pair = {f: (x[0][i], x[1][j]) if first else (x[1][j], x[0][i]) for f, x in texts.items()}
            for measure in (bound, ratio):
                for f in "thd":
                    if up[f]:
                        up[f] = measure(*pair[f])
                    known = WEIGHTS["title"] * up["t"] + WEIGHTS["meta_description"] * up["d"] + WEIGHTS["h1"] * up["h"] + share
                    if known < least:
                        break
                if known < least:
                    break
            else:
                ends = (urls[0][i], urls[1][j]) if first else (urls[1][j], urls[0][i])
                out.append((*ends, known))
    return pd.DataFrame(out, columns=["url_a", "url_b", "similarity"])


def fuzzy_pairs(pages: DataFrame, threshold: float = 0.85, exclusions: list[str] | None = None, work: list | None = None) -> DataFrame:
    """(url_a, url_b, similarity) of page pairs, in crawl order, whose weighted text similarity reaches the threshold.

    A score of threshold needs a similarity of title and description of at least
    (threshold - 0.65) / 0.35 each. For difflib's ratio 2M/T that bounds lengths,
    so only pages of the same or neighbouring buckets of both lengths meet. Buckets
    are dealt to cells of about CELL pages; a task gets two cells, and bounds by
    lengths, letters and common subsequences leave difflib few of their pairs. All
    pages of a bucket meet: texts of a few dozen letters whose ratio may be as low
    as that share no part that could be looked up instead. At 0.65 or below the
    bounds say nothing, and a ValueError is raised. work gets the number of pairs
    that difflib scores to the end.
    """
    need = (threshold - (1 - WEIGHTS["title"])) / WEIGHTS["title"]
    if need <= 0:
        raise ValueError("the threshold must be above 0.65")
    low = lambda n: F.lower(F.trim(F.coalesce(F.col(n), F.lit(""))))
    rows = pages.where(~excluded(F.col("url"), exclusions or [])).select("ord", "url", low("title").alias("t"), low("meta_description").alias("d"), low("h1").alias("h"), F.coalesce("word_count", F.lit(0)).alias("w"))
    rows = rows.where("t <> '' and d <> ''").groupBy("url").agg(F.min_by(F.struct("ord", "t", "d", "h", "w"), "ord").alias("r")).select("url", "r.*")
    # ratio >= need: the shorter is at least need / (2 - need) of the longer.
    base = -F.log(F.lit(need / (2 - need)))
    bucket = lambda c: F.floor(F.log(F.length(c).cast("double")) / base).cast("int")
    rows = rows.withColumns({f"n{c}": F.length(c) for c in "tdh"} | {f"l{c}": _letters(F.col(c)) for c in "tdh"} | {f"b{c}": bucket(c) for c in "td"})
    rows = materialize(rows, "fuzzy-rows")
    buckets = rows.groupBy("bt", "bd").agg(F.ceil(F.count("*") / CELL).cast("int").alias("cells"))
    rows = rows.join(buckets, ["bt", "bd"]).withColumn("cell", F.concat_ws(":", "bt", "bd", F.pmod(F.xxhash64("url"), F.col("cells"))))
    cells = buckets.select("bt", "bd", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("k")).withColumn("cell", F.concat_ws(":", "bt", "bd", "k"))
    x, y = (cells.select(*[F.col(c).alias(f"{c}{i}") for c in ("bt", "bd", "cell")]) for i in (1, 2))
    met = x.join(y, (F.abs(x.bt1 - y.bt2) <= 1) & (F.abs(x.bd1 - y.bd2) <= 1) & (x.cell1 <= y.cell2)).select("cell1", "cell2")
    met = met.select("cell1", "cell2", F.explode(F.array_distinct(F.array("cell1", "cell2"))).alias("cell"))

    def score(key: tuple, both: pd.DataFrame) -> pd.DataFrame:
        a, b = (both[both.cell == cell] for cell in key)
        return _score_pairs(a, None if key[0] == key[1] else b, threshold)

    pairs = rows.drop("bt", "bd", "cells").join(met, "cell").groupBy("cell1", "cell2").applyInPandas(score, "url_a string, url_b string, similarity double")
    if work is not None:
        pairs = materialize(pairs, "fuzzy-candidates")
        work.append(pairs.count())
    return pairs.where(F.col("similarity") >= threshold)


def fuzzy_issues(pages: DataFrame, threshold: float = 0.85, exclusions: list[str] | None = None) -> DataFrame:
    """Two issues for each fuzzy pair."""
    p = fuzzy_pairs(pages, threshold, exclusions)
    ends = F.explode(F.array(F.struct(F.col("url_a").alias("url"), F.col("url_b").alias("other")), F.struct(F.col("url_b").alias("url"), F.col("url_a").alias("other"))))
    rows = p.select("similarity", ends.alias("e")).select("similarity", "e.*")
    return _rows(rows, "warning", "Duplication", "Duplicate Content Detected", F.concat(F.lit("Content is "), F.format_string("%.1f", F.col("similarity") * 100), F.lit("% similar to "), "other"))


def post_crawl_issues(pages: DataFrame, sitemap: DataFrame, threshold: float = 0.85, exclusions: list[str] | None = None) -> DataFrame:
    out = fuzzy_issues(pages, threshold, exclusions)
    for more in (redirect_issues(pages, exclusions), duplicate_issues(pages, exclusions), sitemap_issues(pages, sitemap, exclusions)):
        out = out.unionByName(more)
    return out.select(*ISSUE_COLUMNS)


def finish_crawl(pages: DataFrame, links: DataFrame, sitemap: DataFrame, threshold: float = 0.85, exclusions: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages with linked_from, links with the targets' statuses, issues across pages): what is due once a crawl has ended."""
    from pagequill.operators.linkgraph import linked_from, resolve_status

    return pages.join(linked_from(pages, links), "url", "left"), resolve_status(links, pages), post_crawl_issues(pages, sitemap, threshold, exclusions)
