"""Crawls as Parquet: catalog, saved relations, exports, report."""

from __future__ import annotations

import html
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequill.functions import scalars

CATALOG = "crawl_id long, user_id long, base_url string, status string, started_at timestamp, completed_at timestamp, urls_crawled long, config string, checkpoint string"
FLATTENED = {
    "analytics": lambda: scalars.analytics_labels(),
    "og_tags": lambda: scalars.counted("og_tags", "tags"),
    "twitter_tags": lambda: scalars.counted("twitter_tags", "tags"),
    "json_ld": lambda: scalars.counted("json_ld", "scripts"),
    "images": lambda: scalars.counted("images", "images"),
    "internal_links": lambda: F.concat(F.coalesce("internal_links", F.lit(0)).cast("string"), F.lit(" internal links")),
    "external_links": lambda: F.concat(F.coalesce("external_links", F.lit(0)).cast("string"), F.lit(" external links")),
    "h2": lambda: scalars.first_three("h2"),
    "h3": lambda: scalars.first_three("h3"),
}


def export_rows(pages: DataFrame, fields: list[str]) -> DataFrame:
    """The chosen fields as flat text or numbers; other containers as JSON, unknown fields empty."""

    def one(f: str) -> Column:
        if f not in pages.columns:
            return F.lit("").alias(f)
        if f in FLATTENED:
            return FLATTENED[f]().alias(f)
        kind = pages.schema[f].dataType.typeName()
        return (F.to_json(f) if kind in ("array", "map", "struct") else F.col(f)).alias(f)

    return pages.select(*map(one, fields))


def export_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def export_xml(rows: DataFrame, path: str, root: str = "crawl", row: str = "url") -> None:
    rows.write.mode("overwrite").format("xml").option("rootTag", root).option("rowTag", row).save(path)


def link_rows(links: DataFrame) -> DataFrame:
    yes = F.when(F.coalesce("is_internal", F.lit(False)), "Yes").otherwise("No")
    return links.select("source_url", "target_url", "anchor_text", yes.alias("is_internal"), "target_domain", F.coalesce(F.col("target_status").cast("string"), F.lit("")).alias("target_status"), "placement")


def issues_by_url(issues: DataFrame) -> DataFrame:
    """(url, n, issues): a URL's issues as an array."""
    return issues.groupBy("url").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("issue", "type", "category", "details"))).alias("issues"))


def export_issues(issues: DataFrame, path: str) -> None:
    """CSV of the five issue columns."""
    export_csv(issues.select("url", "type", "category", "issue", "details"), path)


def json_envelope(rows: DataFrame, fields: list[str], date: str, most: int = 100_000) -> str:
    """The JSON document of a small export. More than `most` rows raise ValueError: those are for export_json."""
    data = [r.asDict(recursive=True) for r in export_rows(rows, fields).limit(most + 1).collect()]
    if len(data) > most:
        raise ValueError(f"more than {most} rows: use export_json")
    return json.dumps({"export_date": date, "total_urls": len(data), "fields": fields, "data": data}, default=str)


def export_xlsx(sheets: dict[str, DataFrame], path: str, most: int = 1_048_575) -> None:
    """An XLSX workbook on the driver, row by row; a sheet of more rows than the format allows raises ValueError."""
    import tempfile
    import zipfile

    text = lambda v: "".join(c for c in html.escape("" if v is None else str(v)) if c >= " " or c in "\t\n")
    cell = lambda v: f"<c><v>{v}</v></c>" if isinstance(v, int | float) and not isinstance(v, bool) else f'<c t="inlineStr"><is><t xml:space="preserve">{text(v)}</t></is></c>'
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office, package = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{text(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{office}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">{links}</Relationships>')
        for i, rows in enumerate(sheets.values(), 1):
            with tempfile.NamedTemporaryFile("w", encoding="utf-8") as out:
                out.write(f'{head}<worksheet xmlns="{main}"><sheetData><row>{"".join(map(cell, rows.columns))}</row>')
                for k, row in enumerate(rows.toLocalIterator()):
                    if k >= most:
                        raise ValueError(f"more than {most} rows in a sheet")
                    out.write(f"<row>{''.join(map(cell, row))}</row>")
                out.write("</sheetData></worksheet>")
                out.flush()
                z.write(out.name, f"xl/worksheets/sheet{i}.xml")


CRAWL_FILE = "1.1"


def save_crawl(path: str, pages: DataFrame, links: DataFrame, issues: DataFrame) -> None:
    """A whole crawl as JSON lines in one folder: url, links and issues, and the version of the form."""
    for name, rows in (("urls", pages), ("links", links), ("issues", issues)):
        export_json(rows, f"{path}/{name}")
    export_json(pages.sparkSession.createDataFrame([(CRAWL_FILE,)], "version string"), f"{path}/version")


def load_crawl(spark: SparkSession, path: str, pages: str, links: str, issues: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What save_crawl has written, by the given schemas; another version raises ValueError."""
    version = spark.read.json(f"{path}/version").first()
    if not version or version["version"] != CRAWL_FILE:
        raise ValueError("no crawl of this version")
    return tuple(spark.read.schema(kind).json(f"{path}/{name}") for name, kind in (("urls", pages), ("links", links), ("issues", issues)))


#: What the log says of each file of a committed batch; a batch without rows has one entry without a file.
LOG = "version long, batch string, folder string, kind string, file string, rows long, first long, last long"


@dataclass
class CrawlStore:
    """All crawls under one folder, with a log of what has been committed.

    A batch of a relation is written to a folder of its own, sorted by its order
    column, and counts once the log names it: readers see whole batches, saved
    and streamed ones alike. A batch that is tried again under its name adds
    nothing if it has been committed; what a stopped attempt has left is in no
    log, so nobody reads it. The log has the range of each file, by which pages
    of rows are read from few files. Versions number the batches of a relation of
    a crawl; one job at a time writes there, any number reads.
    """

    spark: SparkSession
    root: str

    def path(self, relation: str) -> str:
        return f"{self.root}/{relation}"

    def _fs(self, path: str):  # noqa: ANN202
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def has(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _log_path(self, relation: str, crawl_id: int) -> str:
        return f"{self.root}/log/{relation}/crawl_id={crawl_id}"

    def log(self, relation: str, crawl_id: int) -> DataFrame:
        """The entries of a relation of a crawl, see LOG."""
        path = self._log_path(relation, crawl_id)
        return self.spark.read.schema(LOG).parquet(path) if self.has(path) else self.spark.createDataFrame([], LOG)

    def version(self, relation: str, crawl_id: int) -> int:
        """The last committed version, 0 if there is none."""
        return self.log(relation, crawl_id).agg(F.max("version")).first()[0] or 0

    def _commit(self, relation: str, crawl_id: int, entries: DataFrame) -> int:
        """Add entries as the next version, in one file, which is there as a whole or not at all."""
        version = self.version(relation, crawl_id) + 1
        rows = entries.withColumn("version", F.lit(version).cast("long")).select("version", "batch", "folder", "kind", "file", "rows", "first", "last")
        rows.coalesce(1).write.mode("append").parquet(self._log_path(relation, crawl_id))
        return version

    def save(self, relation: str, rows: DataFrame, crawl_id: int, batch: str | None = None, order: str = "ord") -> int:
        """Commit a batch and return its version; a batch of this name that is there already is left as it is.

        Rows are dealt to files by ranges of the order column, if they have a
        whole-number column of that name, and sorted within.
        """
        batch = batch or uuid.uuid4().hex
        there = self.log(relation, crawl_id).where(F.col("batch") == batch).agg(F.max("version")).first()[0]
        if there:
            return there
        folder = f"{self.path(relation)}/crawl_id={crawl_id}/{uuid.uuid4().hex}"
        sorts = order in rows.columns and rows.schema[order].dataType.typeName() in ("long", "integer", "short", "byte")
        (rows.repartitionByRange(order).sortWithinPartitions(order) if sorts else rows).write.parquet(folder)
        at = F.col(order).cast("long") if sorts else F.lit(None).cast("long")
        files = self.spark.read.schema(rows.schema).parquet(folder).select(F.col("_metadata.file_path").alias("file"), at.alias("at"))
        entries = files.groupBy("file").agg(F.count("*").alias("rows"), F.min("at").alias("first"), F.max("at").alias("last"))
        none = self.spark.createDataFrame([(0,)], "rows long").select(F.lit(None).cast("string").alias("file"), "rows", F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"))
        return self._commit(relation, crawl_id, (none if entries.isEmpty() else entries).withColumns({"batch": F.lit(batch), "folder": F.lit(folder), "kind": F.lit(rows.schema.json())}))

    def _read(self, entries: DataFrame, files: bool = False) -> DataFrame:
        """The rows of the batches (or files) of some entries; columns that only some of them have are null in the others."""
        place = "file" if files else "folder"
        rows = entries.where(F.col("folder").isNotNull()).groupBy(place, "kind").agg(F.min("version").alias("version")).collect()
        if not rows:
            raise LookupError("nothing has been saved there")
        fields: dict[str, T.StructField] = {}
        for kind in dict.fromkeys(r["kind"] for r in sorted(rows, key=lambda r: r["version"])):
            for f in T.StructType.fromJson(json.loads(kind)):
                fields.setdefault(f.name, T.StructField(f.name, f.dataType))
        return self.spark.read.schema(T.StructType([*fields.values()])).parquet(*[r[place] for r in rows])

    def load(self, relation: str, crawl_id: int, limit: int | None = None, offset: int = 0, order: str | None = None, version: int | None = None) -> DataFrame:
        """The rows of a relation of a crawl, as of a version if one is given; a later commit changes nothing in them."""
        log = self.log(relation, crawl_id)
        rows = self._read(log if version is None else log.where(F.col("version") <= version))
        if limit is not None or offset:
            rows = rows.orderBy(order or rows.columns[0]).offset(offset)
            rows = rows.limit(limit) if limit is not None else rows
        return rows

    def page(self, relation: str, crawl_id: int, after: int | None, limit: int, order: str = "ord", version: int | None = None) -> DataFrame:
        """The `limit` rows that follow `after` in the order (from the start if it is None): pass the last row's value to get the next page. No two rows may have one value.

        The log tells which files can hold them: the files wholly behind `after`
        that end first hold `limit` rows up to some value, and files that begin
        behind that value are not opened, nor those that end before `after`. Rows
        without a value of the order are on no page.
        """
        log = self.log(relation, crawl_id).where(F.col("file").isNotNull())
        log = log if version is None else log.where(F.col("version") <= version)
        left = log if after is None else log.where(F.col("last") > after)
        whole = left if after is None else left.where(F.col("first") > after)
        held, upto = 0, None
        for r in whole.orderBy("last").select("rows", "last").limit(limit).collect():
            held, upto = held + r["rows"], r["last"]
            if held >= limit:
                break
        if held >= limit:
            left = left.where(F.col("first") <= upto)
        rows = self.load(relation, crawl_id).limit(0) if left.isEmpty() else self._read(left, files=True)
        return rows.where(F.col(order).isNotNull() if after is None else F.col(order) > after).orderBy(order).limit(limit)

    def refresh(self, relation: str, crawl_id: int) -> int:
        """Ask every reader of changes to take all rows anew, once."""
        entry = self.spark.createDataFrame([(0,)], "rows long")
        none = {c: F.lit(None).cast(kind) for c, kind in (("folder", "string"), ("kind", "string"), ("file", "string"), ("first", "long"), ("last", "long"))}
        return self._commit(relation, crawl_id, entry.withColumns(none | {"batch": F.lit("refresh")}))

    def changes(self, relation: str, crawl_id: int, since: int = 0) -> tuple[DataFrame | None, int, bool]:
        """(rows, cursor, full): what has been committed after the cursor `since`, each row once, however readers filter.

        full says that the rows are all there are and replace what was read
        before: at the first poll, and once after each refresh. rows is None
        where nothing is new. The next poll passes the new cursor.
        """
        now = self.version(relation, crawl_id)
        log = self.log(relation, crawl_id).where(F.col("version") <= now)
        new = log.where(F.col("version") > since)
        full = not since or not new.where("batch = 'refresh'").isEmpty()
        rows = (log if full else new).where(F.col("folder").isNotNull())
        return (None if rows.isEmpty() else self._read(rows)), now, full

    def catalog(self) -> DataFrame:
        """Latest state of each crawl: states are appended, and the newest of an id counts."""
        if not self.has(self.path("catalog")):
            return self.spark.createDataFrame([], CATALOG)
        rows = self.spark.read.parquet(self.path("catalog"))
        keep = [f.name for f in self.spark.createDataFrame([], CATALOG).schema]
        last = rows.groupBy("crawl_id").agg(F.max_by(F.struct(*rows.columns), "version").alias("r")).select("r.*")
        return last.where("status <> 'deleted'").select(*keep)

    def record(self, crawl: DataFrame) -> None:
        """Add crawls, or new states of them."""
        crawl.withColumn("version", F.unix_micros(F.current_timestamp())).write.mode("append").parquet(self.path("catalog"))

    def set_status(self, crawl_id: int, status: str) -> None:
        done = F.when(F.lit(status).isin("completed", "failed", "stopped"), F.current_timestamp()).otherwise(F.col("completed_at"))
        self.record(self.catalog().where(F.col("crawl_id") == crawl_id).withColumns({"status": F.lit(status), "completed_at": done}))

    def list(self, status: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        rows = self.catalog().where(F.col("status") == status) if status else self.catalog()
        return rows.orderBy(F.desc("started_at"), F.desc("crawl_id")).offset(offset).limit(limit)

    def histogram(self) -> DataFrame:
        return self.catalog().groupBy("status").agg(F.count("*").alias("n"))

    def fail_running(self) -> None:
        """At start: what is still running has crashed."""
        self.record(self.catalog().where("status = 'running'").withColumn("status", F.lit("failed")))

    def delete(self, crawl_id: int) -> None:
        """The crawl and all its rows."""
        gone = self.catalog().where(F.col("crawl_id") == crawl_id).withColumn("status", F.lit("deleted"))
        self.record(gone)
        for relation in ("pages", "links", "issues"):
            for path in (self._log_path(relation, crawl_id), f"{self.path(relation)}/crawl_id={crawl_id}"):
                fs, p = self._fs(path)
                fs.delete(p, True)

    def expire(self, days: int) -> int:
        """Delete crawls that started more than so many days ago."""
        old = [r[0] for r in self.catalog().where(F.col("started_at") < F.current_timestamp() - F.expr(f"interval {days} days")).select("crawl_id").collect()]
        for k in old:
            self.delete(k)
        return len(old)

    def bytes(self) -> int:
        fs, p = self._fs(self.root)
        return fs.getContentSummary(p).getLength()


def parsed(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Columns of JSON text as arrays or maps of the given types; what is null or no JSON of the type is empty."""
    empty = lambda kind: (F.create_map() if kind.startswith("map") else F.array()).cast(kind)
    whole = lambda c, kind: F.when(F.try_parse_json(c).isNotNull(), F.from_json(c, kind))  # noqa: E731  a cut text is no JSON, though from_json reads its beginning
    return rows.withColumns({c: F.coalesce(whole(F.col(c), kind), empty(kind)) for c, kind in kinds.items()})


@dataclass
class SettingsStore:
    """Settings by user: states are appended, and the newest counts."""

    spark: SparkSession
    path: str

    def all(self) -> DataFrame:
        """(user_id, settings as JSON) of each user."""
        store = CrawlStore(self.spark, self.path)
        if not store.has(self.path):
            return self.spark.createDataFrame([], "user_id long, settings string")
        rows = self.spark.read.parquet(self.path).groupBy("user_id").agg(F.max_by("settings", "version").alias("settings"))
        return rows.where(F.col("settings").isNotNull())

    def save(self, settings: DataFrame) -> None:
        """Insert or replace the settings (user_id, settings) of users; a null deletes them, so that defaults hold."""
        settings.select("user_id", "settings", F.unix_micros(F.current_timestamp()).alias("version")).write.mode("append").parquet(self.path)

    def get(self, user_id: int, defaults: dict) -> dict:
        row = self.all().where(F.col("user_id") == user_id).first()
        return defaults | (json.loads(row["settings"]) if row else {})


def _table(head: list[str], rows: list[list]) -> str:
    cell = lambda tag, v: f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>"
    lines = ["<tr>" + "".join(cell("td", v) for v in r) + "</tr>" for r in rows]
    return "<table><tr>" + "".join(cell("th", h) for h in head) + "</tr>" + "".join(lines) + "</table>"


def html_report(summary, site_url: str, links: int = 20, orphans: int = 20, clusters: int = 15) -> str:  # noqa: ANN001
    """A page with the summary's top groups, broken links, orphans and clusters; every value escaped."""
    top = summary.groups.limit(10).collect()
    t = summary.totals.first()
    parts = [
        f"<h1>Site audit: {html.escape(site_url)}</h1><p>Score {t['site_score']}; {t['total_pages']} pages, {t['orphan_count']} orphans, {t['broken_link_count']} broken links.</p>",
        "<h2>Issues</h2>" + _table(["Issue", "Severity", "Pages", "Fix"], [[r["issue"], r["severity"], r["affected_url_count"], r["recommended_fix"]] for r in top]),
        "<h2>Broken links</h2>" + _table(["From", "To", "Status"], [[r["source_url"], r["target_url"], r["target_status"]] for r in summary.broken.orderBy("source_url", "target_url").limit(links).collect()]),
        "<h2>Orphans</h2>" + _table(["Page"], [[r["url"]] for r in summary.metrics.where("is_orphan").orderBy("ord").limit(orphans).collect()]),
        "<h2>Clusters</h2>" + _table(["Cluster", "Pages"], [[r["name"], r["size"]] for r in summary.clusters.limit(clusters).collect()]),
    ]
    return "<!DOCTYPE html><html><head><meta charset='utf-8'><title>Site audit</title></head><body>" + "".join(parts) + "</body></html>"
