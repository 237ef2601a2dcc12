import hashlib
import uuid

from pyspark.sql import functions as F

from strandline.llm import shared, warc


def brute(rows, least):
    best = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if len(p) >= least and i is not None:
            best[p] = max(best.get(p, i), i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        to = best.get(p) if i is not None and len(p) >= least and best.get(p) != i else None
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if to is not None else "response", to))
    return sorted(out, key=str)


def test_round_trip(spark):
    big, other = "<p>x</p>\r\n\r\nWARC/1.1\r\n" * 60, "é" * 600
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, big), (4, "http://c d\r\nX: y", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (8, "u", other), (9, "u", other), (None, "u", big), (9, "u", other), (10, "u", "z" * 300_000)]
    pages = spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, digest string, id int")
    path = shared.fresh_path(spark, f"warc-test-{uuid.uuid4().hex}")
    warc.write_archives(pages, path, least_bytes=1000, file_bytes=4096)
    got = warc.read_archives(spark, path).collect()
    assert sorted(((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in got), key=str) == brute(rows, 1000)
    for x in got:
        assert hashlib.sha1(bytes(x.payload)).hexdigest() == x.payload_digest


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = shared.fresh_path(spark, "warc-test")
    warc.write_archives(pages, path)
    assert warc.read_archives(spark, path).count() == 0


def test_record_ids_and_lost_responses(spark):
    import gzip
    import re

    big = "x" * 2000
    rows = [(1, "u", big), (2, "u", big), (2, "u", big), (None, "u", "a"), (None, "u", "a"), (3, "u", "b"), (3, "u", "b"), (4, "u", "c")]
    path = shared.fresh_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path, file_bytes=1)
    names = []
    for r in spark.read.format("binaryFile").load(path).select("content").collect():
        names += re.findall(rb"WARC-Record-ID: (\S+)", gzip.decompress(bytes(r.content)))
    assert len(names) == len(set(names)) == len(rows)
    got = warc.read_archives(spark, path)
    assert sorted((x.page_id, x.record_type) for x in got.collect() if x.page_id) == [(1, "revisit"), (2, "response"), (2, "response"), (3, "response"), (3, "response"), (4, "response")]
    # an archive of revisits alone: reported, with nothing to resolve them by
    lost = shared.fresh_path(spark, "warc-test")
    text = spark.read.option("lineSep", "\x00").text(path).where("value like '%WARC-Type: revisit%'")
    text.select(F.substring_index("value", "WARC/1.1", -1).alias("v")).select(F.concat(F.lit("WARC/1.1"), F.regexp_replace("v", "(\r\n)+$", ""), F.lit("\r\n\r\n")).alias("value")).write.option("lineSep", warc.END).option("compression", "gzip").text(lost)
    found = warc.read_archives(spark, lost).collect()
    assert [(x.page_id, x.record_type, x.payload_bytes, x.refers_to, x.payload) for x in found] == [(1, "revisit", None, 2, None)]


def test_repeated_rows_fill_no_file(spark):
    """One row in two thirds of the table, and a frequent payload under many ids."""
    import gzip

    rows = [(7, "u", "r" * 2000)] * 600 + [(100 + i, "u", f"{i:05d}" * 400) for i in range(300)] + [(1000 + i, "u", "s" * 2000) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(9)
    for least, limit in ((10**9, 2000 * 10 * 2), (1000, 2000 * 10 * 2)):
        path = shared.fresh_path(spark, "warc-test")
        warc.write_archives(pages, path, least_bytes=least, file_bytes=20_000, partitions=64)
        sizes = []
        for r in spark.read.format("binaryFile").load(path).select("content").collect():
            sizes.append(sum(len(body) for _, _, body in warc.parsed(gzip.decompress(bytes(r.content)))))
        assert max(sizes) <= limit, sorted(sizes)[-5:]
        got = warc.read_archives(spark, path, with_payload=False).collect()
        assert sorted(((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in got), key=str) == brute(rows, least)


def test_fresh_headers(spark):
    import gzip

    rows = [(1, "http://one", "p" * 1500), (2, "http://two x", "p" * 1500), (3, None, "q")]
    path = shared.fresh_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path, date="2024-05-06T07:08:09Z")
    found = {}
    for r in spark.read.format("binaryFile").load(path).select("content").collect():
        found |= {h["WARC-Target-URI"]: h for h, _, _ in warc.parsed(gzip.decompress(bytes(r.content)))}
    again = found["http://one"]
    assert again["WARC-Type"] == "revisit" and again["WARC-Refers-To-Target-URI"] == "http://two%20x" and again["WARC-Refers-To-Date"] == "2024-05-06T07:08:09Z"
    assert {h["WARC-Date"] for h in found.values()} == {"2024-05-06T07:08:09Z"} and set(found) == {"http://one", "http://two%20x", "about:blank"}
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path := shared.fresh_path(spark, "warc-test"))
    assert "WARC-Date: 20" in spark.read.option("lineSep", "\x00").text(path).first()[0]


def test_payloads_move_once(spark):
    """A join by place keeps the partitions that become files: rows are exchanged once, marks once."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        by = lambda df: df.withColumn("place", warc.place(F.col("id"), F.lit("d"), F.lit(0)))
        joined = by(spark.range(10)).repartition(3, "place").join(by(spark.range(10)).select("place"), "place", "left")
        assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
