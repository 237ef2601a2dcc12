"""WARC archives with revisit records for payloads that are held already.

Pages become records with fresh headers. Headers alone (id, length, digest) are
stored and shuffled by payload digest, salted where a digest is frequent; of
equal payloads of at least `least_bytes` bytes, that of the largest id stays a
response and the others become revisits of it. Payloads then move once, to the
task that writes them: rows are dealt by id and digest, and rows that repeat both
so often that they would fill a file by themselves are dealt over several tasks.
Archives are written by Spark's text sink, whose separator is the blank line that
ends each record, so they go to any file system that Spark can write, under its
commit protocol. There are at most PARTITIONS tasks; a task begins a new file after
as many records as have `file_bytes` on average. The sink compresses a file as one
gzip member. Reading takes whole archive files, follows Content-Length, checks
length and digest of each payload, keeps the records in a table, and joins
revisits to their originals.

Defined results: a null payload is an empty one; a null url is written as
"about:blank"; of rows that repeat the largest id all are responses; a row
without an id is a response. Record ids name the digest and the page; records
that repeat both have a number in theirs. A payload may be of any length: it is
one record of one file. A revisit whose response is in no archive is returned
with null length and payload. An empty table gives no records.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.shared import looked_up, maybe_broadcast, written

END = "\r\n\r\n"
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes of one archive file before compression, tasks that write.
FILE_BYTES, PARTITIONS = 16 << 20, 20_000


def target(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("about:blank")), r"[\x00-\x20\x7F]+", "%20")


def payload_headers(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """id, url, payload_bytes, payload_digest (hex SHA-1) of each page."""
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    return pages.select(
        F.col(id_col).alias("id"),
        target(F.col(url_col)).alias("url"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha1(payload).alias("payload_digest"),
    )


def marks(headers: DataFrame, least_bytes: int) -> DataFrame:
    """id, digest, refers_to, refers_url, repeated of the rows that become revisits or whose id and payload occur more than once."""
    pairs = headers.groupBy("id", F.col("payload_digest").alias("digest")).agg(F.count("*").alias("n"), F.max("payload_bytes").alias("size"), F.max("url").alias("url"))
    large = pairs.where(F.col("size") >= least_bytes)
    first = F.max(F.when(F.col("id").isNotNull(), F.struct("id", "url")))
    originals = large.groupBy("digest").agg(first.alias("first"), F.sum("n").alias("all")).where("all > 1").select("digest", F.col("first.id").alias("refers_to"), F.col("first.url").alias("refers_url"))
    again = looked_up(large.select("id", "digest", "n"), "digest", "id", originals).where("id <> refers_to")
    again = again.select("id", "digest", "refers_to", "refers_url", (F.col("n") > 1).alias("repeated"))
    known = again.select("id", "digest", F.lit(True).alias("known"))
    same = lambda c: F.col(f"p.{c}").eqNullSafe(F.col(f"k.{c}"))
    rest = pairs.where("n > 1").alias("p").join(known.alias("k"), same("id") & same("digest"), "left_anti")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return again.unionByName(rest.select("id", "digest", none(dict(headers.dtypes)["id"], "refers_to"), none("string", "refers_url"), F.lit(True).alias("repeated")))


def record(url: Column, uid: Column, number: Column, payload: Column, size: Column, digest: Column, refers_to: Column, refers_url: Column, date: str) -> Column:
    """The record's text without its ending blank line."""
    again = refers_to.isNotNull()
    revisit = F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To-Target-URI: "), refers_url, F.lit(f"\r\nWARC-Refers-To-Date: {date}\r\nWARC-Refers-To: "))
    block = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        size.cast("string"),
        F.lit(END),
        F.when(again, "").otherwise(payload),
    )
    name = lambda x, n: F.concat(F.lit("<urn:page:"), digest, F.lit(":"), n.cast("string"), F.lit(":"), F.coalesce(x.cast("string"), F.lit("none")), F.lit(">"))
    return F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "),
        F.when(again, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "),
        name(uid, number),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        target(url),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        digest,
        F.when(again, F.concat(revisit, name(refers_to, F.lit(0)))).otherwise(""),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(END),
        block,
    )


def place(uid: Column, digest: Column, salt: Column) -> Column:
    """One key of a row's id (or its absence), digest and share; rows and marks meet by it, in the partitions that become files."""
    return F.concat(digest, F.lit(":"), salt.cast("string"), F.lit(":"), F.coalesce(uid.cast("string"), F.lit("none")))


def write_archives(
    pages: DataFrame, path: str, least_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url",
    html_col: str = "html", file_bytes: int = FILE_BYTES, date: str | None = None, partitions: int = PARTITIONS,
) -> None:
    """Writes pages as deduplicated WARC files under path; date: of all records, as WARC has it, now by default."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    headers = written(payload_headers(pages, id_col, url_col, html_col), "headers")
    total, records = headers.agg(F.coalesce(F.sum("payload_bytes"), F.lit(0)), F.count("*")).first()
    # ids and digests that fill half a file by themselves, at most two for each file, and the shares that their rows are dealt in
    own_bytes, half = F.sum("payload_bytes"), max(1, file_bytes // 2)
    full = headers.groupBy(F.col("id").alias("f_id"), F.col("payload_digest").alias("f_digest")).agg(own_bytes.alias("own"), F.count("*").alias("n")).where((F.col("own") >= half) & (F.col("n") > 1))
    shares = F.least(F.col("n"), F.ceil(F.col("own") / half)).cast("int")
    full = maybe_broadcast(written(full.select("f_id", "f_digest", shares.alias("shares")), "full"))
    dealt = lambda rows: rows.join(full, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("digest") == F.col("f_digest")), "left").drop("f_id", "f_digest")

    payload = F.coalesce(F.col(html_col), F.lit(""))
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(F.encode(payload, "UTF-8")).alias("digest"))
    salt = F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("shares")), F.lit(0))
    own = dealt(own).withColumn("place", place(F.col("id"), F.col("digest"), salt)).repartition(max(1, min(partitions, -(-total // file_bytes))), "place")
    every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("shares"), F.lit(1)) - 1))
    marked = dealt(written(marks(headers, least_bytes), "marks")).withColumn("salt", every)
    marked = marked.select(place(F.col("id"), F.col("digest"), F.col("salt")).alias("place"), "refers_to", "refers_url", "repeated")
    rows = own.join(marked, "place", "left")
    number = F.when(F.col("repeated"), F.monotonically_increasing_id() + 1).otherwise(0)
    text = record(F.col("url"), F.col("id"), number, F.col("payload"), F.octet_length("payload"), F.col("digest"), F.col("refers_to"), F.col("refers_url"), date)
    each = max(1, -(-file_bytes * records // max(1, total)))  # of payloads without bytes a file takes them all
    rows.select(text).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", each if total else 0).text(path)


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], int, bytes]]:
    """(headers, declared payload length, payload) of each record of an archive."""
    at = 0
    while at < len(data):
        split = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:split].decode().split("\r\n")
        if version != VERSION:
            raise ValueError(f"no record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines)
        start = split + 4
        end = start + int(headers["Content-Length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut")
        body = data.index(b"\r\n\r\n", start, end) + 4
        declared = data[start:body].rpartition(b"Content-Length: ")[2]
        yield headers, int(declared), data[body:end]
        at = end + 4


def read_archives(spark: SparkSession, path: str, id_type: str = "long", with_payload: bool = True) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to and, if asked for, payload.

    Payloads are checked against their length and digest. Revisits take the
    length, and the payload, of the response they refer to; both are null if it
    is in no archive.
    """
    schema = f"id {id_type}, url string, record_type string, n long, digest string, refers {id_type}" + ", body binary" * with_payload

    def named(urn: str | None) -> str | None:
        if urn is None:
            return None
        page = urn.removeprefix("<urn:page:").removesuffix(">").split(":", 2)[2]
        return None if page == "none" else page

    def records(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gzip
        import hashlib

        for part in parts:
            for data in part["content"]:
                rows = []
                for headers, declared, body in parsed(gzip.decompress(data)):
                    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (len(body) != declared or hashlib.sha1(body).hexdigest() != digest):
                        raise ValueError(f"damaged payload of {headers['WARC-Record-ID']}")
                    row = (named(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], kind, declared, digest, named(headers.get("WARC-Refers-To")))
                    rows.append((*row, body) if with_payload else row)
                out = pd.DataFrame(rows, columns=["id", "url", "record_type", "n", "digest", "refers", *["body"] * with_payload])
                if id_type in ("bigint", "long", "int"):
                    out["id"], out["refers"] = (pd.array([None if x is None else int(x) for x in out[c]], dtype="Int64") for c in ("id", "refers"))
                yield out

    found = written(spark.read.format("binaryFile").load(path).select("content").mapInPandas(records, schema), "records")
    first = found.where("record_type = 'response' and id is not null").select(
        F.col("id").alias("o_id"), F.col("digest").alias("o_digest"), F.col("n").alias("o_n"), *[F.col("body").alias("o_body")] * with_payload
    )
    # a digest has one response that is referred to: its revisits meet it by digest, salted by page
    first = first.dropDuplicates(["o_id", "o_digest"]).withColumnRenamed("o_digest", "digest")
    referred = found.where("record_type = 'revisit'").select("digest", F.col("refers").alias("o_id")).distinct()
    first = first.join(referred, ["digest", "o_id"], "left_semi").dropDuplicates(["digest"])
    again = looked_up(found.where("record_type = 'revisit'"), "digest", "id", first, how="left")
    held = found.where("record_type = 'response'")
    columns = lambda n, body: [
        F.col("id").alias("page_id"), "url", "record_type", F.col(n).alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("refers").alias("refers_to"), *[F.col(body).alias("payload")] * with_payload,
    ]
    return held.select(*columns("n", "body")).unionAll(again.select(*columns("o_n", "o_body")))
