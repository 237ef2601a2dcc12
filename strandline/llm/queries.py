"""The queries op1_ to op13_ over the shared test tables, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import ann, centroids, decontam, divergence, html_text, langid, lm, neardup, pieces, quality, secrets, shared, token_counts, warc


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shared.table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, F.col("id") % 50 == 0, k=5).withColumnRenamed("id", "vec_id")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = shared.table(spark, sf_dir, "pages")
    path = shared.fresh_path(spark, "warc")
    warc.write_archives(pages, path, least_bytes=1000)
    return warc.read_archives(spark, path, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encoded(docs).select("doc_id", F.size("piece_ids").alias("n_pieces"), "piece_ids", "lossless")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    return token_counts.with_suffix_sums(token_counts.length_histogram(docs))


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (shared.table(spark, sf_dir, x) for x in ("documents", "benchmark"))
    return decontam.decontaminated(docs, benchmark, slop=2).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated", "n_near"
    )


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.both_tables(spark, shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (shared.table(spark, sf_dir, x) for x in ("documents", "labels"))
    held_out = shared.crc_mod(F.col("doc_id"), 4) == 2
    return quality.scored(docs, labels, held_out).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(shared.table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    return lm.scored(docs, held_out=shared.crc_mod(F.col("doc_id"), 5) == 1)


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(shared.table(spark, sf_dir, "documents"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scanned(shared.table(spark, sf_dir, "documents")))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(shared.table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(centroids.clustered(shared.table(spark, sf_dir, "embeddings"), vec_col="embedding"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ann, op2_warc, op3_pieces, op4_token_counts, op5_decontam, op6_langid, op7_quality, op8_html_text, op9_lm, op10_neardup,
        op11_secrets, op12_divergence, op13_centroids,
    )
}

SQL = {
    "op2_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS payload_digest
            FROM pages),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes >= 1000) AS top FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
        FROM g""",
    "op5_decontam": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (
            SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
        bw AS (
            SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g
            FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i
                  FROM (SELECT *, least(13, len(w)) AS m FROM b WHERE len(w) > 0))),
        ms AS (SELECT DISTINCT m FROM bw),
        dw AS (
            SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
            FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms)),
        f AS (SELECT doc_id, item_id, m, i FROM dw JOIN bw USING (m, g)),
        h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM f) GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
              FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM f) GROUP BY doc_id),
        ps AS MATERIALIZED (SELECT doc_id, i, term FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS term FROM d) SEMI JOIN (SELECT DISTINCT unnest(w) AS term FROM b) USING (term)),
        bt AS (SELECT item_id, w, s, m, unnest(range(s, s + m)) AS p FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM (SELECT *, least(13, len(w)) AS m FROM b WHERE len(w) > 0))),
        rt AS (SELECT DISTINCT item_id, l[1:2] AS l FROM (
                   SELECT item_id, list(struct_pack(n := n, p := p, term := x.term) ORDER BY n, p, x.term) AS l
                   FROM (SELECT *, w[p] AS term FROM bt) x LEFT JOIN (SELECT term, count(*) AS n FROM ps GROUP BY term) c ON c.term = x.term
                   GROUP BY item_id, w, s, m HAVING count(n) = m)),
        nr AS (SELECT a.doc_id, r.item_id FROM rt r JOIN ps a ON a.term = r.l[1].term WHERE len(r.l) = 1
               UNION SELECT a.doc_id, r.item_id FROM rt r JOIN ps a ON a.term = r.l[1].term JOIN ps b ON b.term = r.l[2].term AND b.doc_id = a.doc_id
               WHERE len(r.l) = 2 AND abs((b.i - r.l[2].p) - (a.i - r.l[1].p)) <= 2),
        ne AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM nr GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0) AS n_near
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN ne USING (doc_id)""",
    "op10_neardup": r"""
        WITH RECURSIVE t AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                          '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (
            SELECT doc_id, list_distinct(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
            FROM t WHERE len(w) > 0),
        e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb
              FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM c WHERE 100 * common >= 75 * (na + nb - common)),
        u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS x, doc_id AS y FROM t UNION SELECT r.x, u.b FROM r JOIN u ON r.y = u.a),
        m AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
        SELECT t.doc_id, coalesce(len(s.s), 0)::BIGINT AS n_shingles, component_id, t.doc_id = component_id AS kept
        FROM t JOIN m USING (doc_id) LEFT JOIN s USING (doc_id)""",
    "op12_divergence": r"""
        WITH d AS (
            SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
            FROM documents),
        g AS (SELECT DISTINCT lang, source FROM d),
        df AS (SELECT lang, t FROM (SELECT lang, unnest(list_distinct(w)) AS t FROM d) GROUP BY lang, t HAVING count(*) >= 10),
        c AS (SELECT lang, source, t, count(*) AS n FROM (SELECT lang, source, unnest(w) AS t FROM d) JOIN df USING (lang, t) GROUP BY ALL),
        v AS (SELECT lang, count(*) AS v FROM df GROUP BY lang),
        gn AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS nn FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
        p AS MATERIALIZED (
            SELECT lang, source, t, coalesce(n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (nn + 2 * v))::HUGEINT AS p
            FROM gn JOIN v USING (lang) JOIN df USING (lang) LEFT JOIN c USING (lang, source, t)),
        q AS (SELECT lang, t, (1 + (1000000000::HUGEINT * (sum(n) + 2)) // (any_value(nn) + 2 * any_value(v)))::HUGEINT AS q
              FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(nn)::HUGEINT AS nn FROM gn GROUP BY lang) USING (lang) GROUP BY lang, t),
        pairs AS (
            SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
                       FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL) x
                   ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
        terms AS (SELECT lang, source, t AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, t) WHERE n > 0 AND p > q)
        SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pairs
        UNION ALL
        SELECT * FROM (SELECT lang, source, 'term', item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM terms) WHERE rank <= 10""",
}


def k_means_sql(k: int = 8, rounds: int = 10) -> str:
    """Every round as tables of its own: a (cluster of each row), c (components of the centroids)."""
    steps = []
    for i in range(rounds + 1):
        near = f"SELECT x, j, sum((v - w) * (v - w)) AS s FROM e JOIN c{i} USING (i) GROUP BY x, j"
        steps.append(f"a{i} AS MATERIALIZED (SELECT x, min(j) AS j, min(s) AS s FROM (SELECT x, j, s, min(s) OVER (PARTITION BY x) AS m FROM ({near})) WHERE s = m GROUP BY x)")
        if i < rounds:
            mean = f"SELECT j, i, (sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS w FROM e JOIN a{i} USING (x) GROUP BY j, i"
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.j, c{i}.i, coalesce(u.w, c{i}.w)::BIGINT AS w FROM c{i} LEFT JOIN ({mean}) u USING (j, i))")
    return f"""
        WITH k AS MATERIALIZED (
            SELECT row_number() OVER () AS x, vec_id, list_transform(embedding, lambda y: floor(1024 * y::DOUBLE)::BIGINT) AS vec FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = 64),
        e AS MATERIALIZED (SELECT x, unnest(range(64)) AS i, unnest(vec)::BIGINT AS v FROM k),
        f AS (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), vec) - 1 AS j, vec FROM k QUALIFY j < {k}),
        c0 AS MATERIALIZED (SELECT j, unnest(range(64)) AS i, unnest(vec)::BIGINT AS w FROM f),
        {', '.join(steps)},
        h AS (SELECT j, sha256(string_agg(w::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY j)
        SELECT vec_id, j::INT AS cluster, s::BIGINT AS distance, (sum(s) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(s) OVER ())::BIGINT AS inertia, centroid_sha256
        FROM a{rounds} JOIN k USING (x) JOIN h USING (j)"""


SQL["op13_centroids"] = k_means_sql()
