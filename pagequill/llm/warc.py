"""WARC archives with revisit records.

Headers (id, payload digest, length) are shuffled by digest, revisits are joined
to the original response, and deduplicated archives are written with fresh
headers. All of it is DataFrame code: records are strings, written by Spark's
text writer with the WARC record terminator as line separator, so that any file
system that Spark can write holds the archives, and read back by splitting at
the record start.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequill.llm.common import join_by_group, materialize, new_path, split_members

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT_BYTES = 1000


def _payload(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def _one_line(col: Column) -> Column:
    return F.regexp_replace(col, r"[\r\n]+", " ")


def _record_id(page: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(":", F.coalesce(page.cast("string"), F.lit("null")), digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def resolve_revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(id, digest, refers_to) of the records that become revisits.

    Of equal payloads of min_bytes or more, the largest id stays a response; a
    null id is smaller than all others. Rows that repeat the largest id stay
    responses too.
    """
    body = _payload(html_col)
    heads = materialize(
        pages.select(F.col(id_col).alias("id"), F.sha1(body).alias("digest"), F.octet_length(body).alias("bytes")).where(F.col("bytes") >= min_bytes).select("id", "digest"),
        "warc-heads",
    )
    total = heads.count()
    originals = heads.groupBy("digest").agg(F.max("id").alias("original"), F.count("*").alias("n")).where("n > 1")
    originals = materialize(originals, "warc-originals")
    found = join_by_group(heads, originals, "digest", "n", total).where(F.col("original").isNotNull() & (F.col("id").isNull() | (F.col("id") < F.col("original"))))
    return found.select("id", "digest", F.col("original").alias("refers_to")).distinct()


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES, date: str | None = None) -> str:
    """Write one WARC 1.1 record per row under path, and a warcinfo record of the archive; return the archive's id.

    Files are text of Spark's own writer, each one gzip stream. Null html is an
    empty payload; a null url has no target header; ids stand URL-encoded in their
    headers, so any text can be one. Rows that repeat id and payload are records
    of one WARC-Record-ID, as they are the same capture. The archive's id is in
    the first header of every record (WARC-Warcinfo-ID) and is fresh for each
    call, so that no payload can hold it.
    """
    archive = f"<urn:uuid:{uuid.uuid4()}>"
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    revisits = materialize(resolve_revisits(pages, id_col, html_col, min_bytes), "warc-revisits")
    body = _payload(html_col)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), F.sha1(body).alias("digest"), F.octet_length(body).alias("bytes"))
    # Only rows that are revisits meet their originals, and their payloads stay behind; responses stay where they are.
    key = F.concat_ws(":", "digest", F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("id").isNull().cast("string"))
    twice, once = split_members(rows.withColumn("key", key), "key", revisits.select(key.alias("member")), "member")
    twice = twice.drop("html").join(revisits.select(key.alias("key"), "refers_to"), "key").withColumn("html", F.lit(""))
    rows = twice.unionByName(once.withColumn("refers_to", F.lit(None).cast(pages.schema[id_col].dataType)))
    again = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    length = F.octet_length(http) + F.when(again, 0).otherwise(F.col("bytes"))

    def field(name: str, value: Column) -> Column:  # null value: no such header
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))

    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Warcinfo-ID: {archive}{CRLF}"),
        field("WARC-Type", F.when(again, "revisit").otherwise("response")),
        field("WARC-Record-ID", _record_id(F.col("id"), F.col("digest"))),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", _one_line(F.col("url"))),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        field("WARC-Refers-To", F.when(again, _record_id(F.col("refers_to"), F.col("digest")))),
        field("WARC-Profile", F.when(again, F.lit(PROFILE))),
        field("X-Page-ID", F.url_encode(F.col("id").cast("string"))),
        field("X-Refers-To-Page-ID", F.url_encode(F.col("refers_to").cast("string"))),
        field("X-Payload-Length", F.col("bytes").cast("string")),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", length.cast("string")),
        F.lit(CRLF),
        http,
        F.when(again, F.lit("")).otherwise(F.col("html")),
    )
    told = f"software: pagequill{CRLF}format: WARC File Format 1.1{CRLF}"
    info = f"WARC/1.1{CRLF}WARC-Warcinfo-ID: {archive}{CRLF}WARC-Type: warcinfo{CRLF}WARC-Record-ID: {archive}{CRLF}WARC-Date: {date}{CRLF}Content-Type: application/warc-fields{CRLF}Content-Length: {len(told)}{CRLF * 2}{told}"
    records = rows.select(record.alias("value")).unionByName(rows.sparkSession.createDataFrame([(info,)], "value string"))
    records.write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)
    return archive


def read_archives(spark: SparkSession, path: str, archive: str, id_type: str = "long") -> DataFrame:
    """Records of an archive but its warcinfo: page_id (of the given type), url, record_type, payload_bytes,
    payload_digest, refers_to, payload (null for a revisit).

    A response's bytes and digest are taken from the payload read back, and
    must agree with its headers; a revisit's come from its headers. A record
    that fails raises.
    """
    start = f"WARC/1.1{CRLF}WARC-Warcinfo-ID: {archive}{CRLF}"
    lines = spark.read.option("lineSep", start).text(path).where("value <> ''")
    head = F.substring_index("value", CRLF * 2, 1)
    rows = lines.select(F.col("value").cast("binary").alias("raw"), F.concat(F.lit(CRLF), head, F.lit(CRLF)).alias("head"), (F.octet_length(head) + 4).alias("at"))

    def field(name: str) -> Column:
        got = F.regexp_extract("head", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
        return F.when(F.col("head").contains(f"{CRLF}{name}: "), got)

    rows = rows.select("raw", "at", F.url_decode(field("X-Page-ID")).cast(id_type).alias("page_id"), field("WARC-Target-URI").alias("url"), field("WARC-Type").alias("record_type"), field("X-Payload-Length").cast("long").alias("told"), F.substring(field("WARC-Payload-Digest"), 6, 40).alias("digest"), F.url_decode(field("X-Refers-To-Page-ID")).cast(id_type).alias("refers_to"), field("Content-Length").cast("int").alias("length"))
    rows = rows.where(F.col("record_type") != "warcinfo")
    block = F.substring(F.col("raw"), F.col("at") + 1, F.col("length"))
    response = F.col("record_type") == "response"
    payload = F.when(response, F.substring(F.col("raw"), (F.col("at") + F.col("length") - F.col("told") + 1).cast("int"), F.col("told").cast("int")))
    rows = rows.withColumns({"payload": payload, "whole": (F.octet_length(block) == F.col("length")) & (F.octet_length("raw") == F.col("at") + F.col("length") + 4)})
    got = F.when(response, F.sha1("payload")).otherwise(F.col("digest"))
    good = F.coalesce(F.col("whole") & (got == F.col("digest")), F.lit(False))
    return rows.select(
        "page_id",
        "url",
        "record_type",
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("told")).alias("payload_bytes"),
        F.when(good, got).otherwise(F.raise_error(F.lit("damaged WARC record")).cast("string")).alias("payload_digest"),
        "refers_to",
        "payload",
    )


def warc_round_trip(pages: DataFrame, path: str | None = None, **columns: str) -> DataFrame:
    """Write pages as deduplicated archives and return the records read back.

    An empty table gives an empty archive. Extra columns are not written.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    archive = write_archives(pages, path, **columns)
    return read_archives(spark, path, archive, pages.schema[columns.get("id_col", "page_id")].dataType.simpleString())
