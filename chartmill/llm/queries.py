"""Queries that apply the operators to the whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartmill.llm import queries_audit
from chartmill.llm.common import read_table
from chartmill.llm.exact_dedup import exact_groups
from chartmill.llm.jaccard_join import jaccard_components
from chartmill.llm.license_scan import scan_licenses
from chartmill.llm.line_dedup import dedup_lines, dedup_passages
from chartmill.llm.packing import pack_documents
from chartmill.llm.quality import fit, labelled_rows, score_quality
from chartmill.llm.sentencepiece_codec import round_trips
from chartmill.llm.token_counts import count_tokens
from chartmill.llm.vector_topk import scaled, top_inner_products, usable
from chartmill.llm.warc import archive, look_up, read_records, url_key

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(queries_audit.QUERIES)
ORACLE_SQL: dict[str, str] = dict(queries_audit.ORACLE_SQL)


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return register


@query(
    "op2_exact_dedup",
    r"""
    WITH t AS (
        SELECT doc_id, length(coalesce(text, '')) AS n,
               regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
        FROM documents
    )
    SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
           doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER g AS kept, sha256(body) AS text_sha256
    FROM t
    WINDOW g AS (PARTITION BY body ORDER BY n DESC, doc_id NULLS LAST)
    """,
)
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents"))


@query("op3_sentencepiece")
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, the digest of what they decode to, and whether that is the text."""
    return round_trips(read_table(spark, sf_dir, "documents"))


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"))


@query("op9_license_scan")
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))


@query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(labelled_rows(docs, read_table(spark, sf_dir, "labels")))
    return score_quality(docs, model)


@query(
    "op8_vector_topk",
    """
    WITH v AS (
        SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS vector
        FROM embeddings
        WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    ), s AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.vector, c.vector) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
    )
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    WHERE rank <= 10
    """,
)
def op8_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").filter(usable(F.col("embedding")))
    vectors = rows.select("vec_id", scaled(F.col("embedding")).alias("vector"))
    return top_inner_products(vectors, vectors.filter("vec_id % 100 = 0"), k=10)


@query(
    "op7_warc",
    """
    WITH p AS (
        SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
    ), g AS (
        SELECT *, min(page_id) OVER (PARTITION BY hex, payload_bytes) AS first FROM p
    )
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
           list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               CAST(((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS INTEGER) >> CAST(5 * (3 - i % 4) AS INTEGER)) & 31) + 1 AS INTEGER), 1) FOR i IN range(32)], 'string_agg', '') AS payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first THEN first END AS refers_to
    FROM g
    """,
)
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    store = archive(pages, least_bytes=0)
    found = look_up(store, pages.select(url_key(F.col("url")).alias("url_key"), "page_id"))
    return read_records(store, found, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_jaccard_join")
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"), width=3, num=90, den=100)


@query("op6_best_fit_packing")
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))


@query(
    "op1_line_dedup",
    """
    WITH l AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
    ), h AS (
        SELECT *, CAST('0x' || substr(md5(line), 1, 7) AS BIGINT) AS hash FROM l
    ), m AS (
        SELECT *, (hash + 31 * coalesce(lag(hash) OVER d, 0)) % 1000003 % 3 = 0 AS mark FROM h WINDOW d AS (PARTITION BY doc_id ORDER BY i)
    ), b AS (
        SELECT *, CASE WHEN mark AND NOT coalesce(lag(mark) OVER d, false) THEN 1 ELSE 0 END AS ends FROM m WINDOW d AS (PARTITION BY doc_id ORDER BY i)
    ), n AS (
        SELECT doc_id, i, line, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM b
    ), c AS (
        SELECT doc_id, no, min(i) AS start, count(*) AS lines, string_agg(line, chr(10) ORDER BY i) AS body, bool_or(trim(line) <> '') AS spoken FROM n GROUP BY doc_id, no
    ), reach AS (
        SELECT doc_id, no, min(start) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS low,
               max(start + lines - 1) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS high FROM c
    ), u AS (
        SELECT doc_id, no, start, lines, body FROM c WHERE lines >= 2 AND spoken
        UNION ALL SELECT doc_id, no, i, 1, line FROM n WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 20
    ), r AS (
        SELECT *, row_number() OVER p AS place, first_value(doc_id) OVER p AS first_doc, first_value(start) OVER p AS first_start, first_value(no) OVER p AS first_no
        FROM u WINDOW p AS (PARTITION BY body ORDER BY doc_id, start)
    ), hit AS (
        SELECT r.*, p.low, p.high, q.low AS first_low, q.high AS first_high
        FROM r JOIN reach p ON p.doc_id = r.doc_id AND p.no = r.no JOIN reach q ON q.doc_id = first_doc AND q.no = first_no WHERE place > 1
    ), gone AS (
        SELECT DISTINCT n.doc_id, n.i FROM hit JOIN n ON n.doc_id = hit.doc_id AND n.i BETWEEN hit.start AND hit.start + hit.lines - 1
    ), around AS (
        SELECT e.doc_id, e.start, e.lines, x.i < e.start AS before, abs(x.i - e.start) AS step, x.i,
               g.i IS NULL AND y.i BETWEEN e.first_low AND e.first_high AND coalesce(x.line = y.line, false) AS equal
        FROM hit e JOIN n x ON x.doc_id = e.doc_id AND (x.i BETWEEN e.low AND e.start - 1 OR x.i BETWEEN e.start + e.lines AND e.high)
        LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.i = x.i LEFT JOIN n y ON y.doc_id = e.first_doc AND y.i = e.first_start + x.i - e.start
    ), grown AS (
        SELECT doc_id, i FROM (SELECT *, bool_and(coalesce(equal, false)) OVER (PARTITION BY doc_id, start, lines, before ORDER BY step) AS so_far FROM around) WHERE so_far
    ), out AS (
        SELECT doc_id, i FROM gone UNION SELECT doc_id, i FROM grown
    ), t AS (
        SELECT n.doc_id, coalesce(string_agg(line, chr(10) ORDER BY n.i) FILTER (out.i IS NULL), '') AS text, count(*) AS n_lines, count(out.i) AS removed_lines
        FROM n LEFT JOIN out ON out.doc_id = n.doc_id AND out.i = n.i GROUP BY n.doc_id
    )
    SELECT t.*, coalesce(k.times, 0) AS removed_chunks FROM t LEFT JOIN (SELECT doc_id, count(*) AS times FROM hit GROUP BY doc_id) k ON k.doc_id = t.doc_id
    """,
)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read_table(spark, sf_dir, "documents"))


@query("op1_passage_dedup")
def op1_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All repeated passages, where ``op1_line_dedup`` has the chunks that its SQL defines."""
    return dedup_passages(read_table(spark, sf_dir, "documents"))
