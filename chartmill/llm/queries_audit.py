"""Queries of the operators that audit a corpus: hard negatives, secrets, manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartmill.llm.common import read_table
from chartmill.llm.hard_negatives import mine_hard_negatives
from chartmill.llm.merkle import verify_manifest
from chartmill.llm.secret_scan import ACCESS, ASSIGN, ASSIGNED, BANDS, ENCODINGS, FALSE_SHARE, FOLDED, HEX, KINDS, MOST_STEPS, STRAY, THIRD, TOKEN, scan_secrets
from chartmill.llm.vector_topk import scaled, usable

# levels that the check SQL unrolls: a million leaves a source, and 4096 sources
SOURCE_LEVELS, TOP_LEVELS = 5, 3


def _manifest_sql() -> str:
    """The manifest in SQL; a tree that is done carries its root through the remaining levels."""

    def leaf(text: str) -> str:
        parts = [f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c} END" for c in ("doc_id", "source", "lang", "n_chars", text)]
        return f"sha256({' || '.join(parts)})"

    # one step per bit: the byte enters with its first step
    crc = """xor(list_reduce(flatten([[CAST(4294967295 AS BIGINT)], flatten([[CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split(CAST(doc_id AS VARCHAR), '')])]),
        lambda a, x: xor(xor(a, x) >> 1, CASE WHEN xor(a, x) % 2 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"""
    low = f"CASE WHEN {crc} % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"
    out = [
        f"d AS (SELECT row_number() OVER () AS rn, doc_id, CASE WHEN source IS NULL THEN '' ELSE 'x' || source END AS s, {leaf('text')} AS leaf, {leaf('low')} AS changed FROM (SELECT *, {low} AS low FROM documents))",
        "n0 AS (SELECT rn, s, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, leaf AS h FROM d)",
    ]

    def grow(name: str, levels: int) -> None:
        for k in range(levels):
            out.append(f"""{name}{k + 1} AS (
                SELECT s, p // 16 AS p, CASE WHEN c = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY p)) END AS h
                FROM (SELECT *, count(*) OVER (PARTITION BY s) AS c FROM {name}{k}) GROUP BY s, p // 16, c)""")

    grow("n", SOURCE_LEVELS)
    out.append(f"t0 AS (SELECT '' AS s, row_number() OVER (ORDER BY s) - 1 AS p, h, s AS of FROM n{SOURCE_LEVELS})")
    grow("t", TOP_LEVELS)
    # own place of each document at every level of both trees, with the folded digest
    out.append("f0 AS (SELECT d.rn, d.s, n0.p, d.changed AS h, CAST('' AS VARCHAR) AS beside FROM d JOIN n0 USING (rn))")
    steps = [f"n{k}" for k in range(SOURCE_LEVELS)] + [f"t{k}" for k in range(TOP_LEVELS)]
    for k, level in enumerate(steps):
        before = f"f{k}"
        if k == SOURCE_LEVELS:
            out.append(f"g AS (SELECT f.rn, '' AS s, t0.p, f.h, f.beside FROM {before} f JOIN t0 ON t0.of = f.s)")
            before = "g"
        out.append(f"""f{k + 1} AS (
            SELECT f.rn, f.s, f.p // 16 AS p, CASE WHEN max(c) = 1 THEN any_value(f.h) ELSE sha256(string_agg(CASE WHEN n.p = f.p THEN f.h ELSE n.h END, '' ORDER BY n.p)) END AS h,
                   f.beside || coalesce(string_agg(n.h, '' ORDER BY n.p) FILTER (n.p <> f.p), '') AS beside
            FROM {before} f JOIN (SELECT *, count(*) OVER (PARTITION BY s) AS c FROM {level}) n ON n.s = f.s AND n.p // 16 = f.p // 16 GROUP BY f.rn, f.s, f.p, f.beside)""")
    return f"""WITH {', '.join(out)}
        SELECT d.doc_id, d.leaf, n{SOURCE_LEVELS}.h AS subroot, t{TOP_LEVELS}.h AS root, sha256(f.beside) AS proof_sha256, f.h AS folded_root, f.h = t{TOP_LEVELS}.h AS verified
        FROM d JOIN f{len(steps)} f USING (rn) JOIN n{SOURCE_LEVELS} ON n{SOURCE_LEVELS}.s = d.s CROSS JOIN t{TOP_LEVELS}"""


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify_manifest(read_table(spark, sf_dir, "documents"))


def _secrets_sql() -> str:
    """Base spans and the battery in SQL, a row per token and per symbol of it."""

    def text(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    # letters of either case as such: this dialect's flag also takes letters outside ASCII
    cut = ASSIGN.index(")", ASSIGN.index("(password"))
    either = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in ASSIGN[ASSIGN.index("(password"):cut]) + ASSIGN[cut:]
    patterns = [either, ACCESS, HEX, TOKEN]
    hits = " UNION ALL ".join(f"""SELECT rn, {k} AS kind, unnest(regexp_extract_all(text, {text(p)}, 0)) AS hit, unnest(regexp_extract_all(text, {text(p)}, {2 if k == 0 else 0})) AS value,
        unnest(regexp_split_to_array(text, {text(p)})) AS gap, generate_subscripts(regexp_split_to_array(text, {text(p)}), 1) AS i FROM d""" for k, p in enumerate(patterns))

    def of_encoding(pick) -> str:
        return "CASE encoding " + " ".join(f"WHEN {k} THEN {pick(e)}" for k, e in enumerate(ENCODINGS)) + " END"

    encoding = "CASE " + " ".join(f"WHEN regexp_matches(hit, {text(e.whole)}) THEN {k}" for k, e in enumerate(ENCODINGS)) + " END"
    folded = f"CASE WHEN encoding IN ({', '.join(str(k) for k, e in enumerate(ENCODINGS) if e.name in FOLDED)}) THEN lower(hit) ELSE hit END"
    band = "CASE " + " ".join(f"WHEN n >= {BANDS[k]} THEN {k}" for k in reversed(range(len(BANDS)))) + " END"
    kind = "CASE kind " + " ".join(f"WHEN {k} THEN '{name}'" for k, name in enumerate(KINDS)) + " END"
    span = f"{kind} || ':' || s || ':' || e"
    return f"""WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text FROM documents), m AS ({hits}), p AS (
        SELECT * FROM (
            SELECT rn, kind, hit, value, CAST(sum(length(gap)) OVER w + coalesce(sum(length(hit)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s
            FROM m WINDOW w AS (PARTITION BY rn, kind ORDER BY i)
        ) WHERE hit IS NOT NULL
    ), b AS (
        SELECT rn, kind, s, s + length(hit) AS e FROM p WHERE kind < 3 AND (kind > 0 OR length(value) >= {ASSIGNED})
    ), t AS (
        SELECT row_number() OVER () AS tid, rn, s, s + length(hit) AS e, length(hit) AS n, encoding, {folded} AS token, {of_encoding(lambda e: text(e.alphabet))} AS alphabet, {of_encoding(lambda e: str(e.collision))} :: DOUBLE AS s2
        FROM (SELECT *, {encoding} AS encoding FROM p WHERE kind = 3 AND NOT regexp_matches(hit, '^[0-9]+$')) WHERE encoding IS NOT NULL
    ), c AS (
        SELECT tid, unnest(string_split(token, '')) AS c, generate_subscripts(string_split(token, ''), 1) AS i, alphabet, length(alphabet) AS a FROM t
    ), v AS (
        SELECT tid, i, instr(alphabet, c) AS v, instr(alphabet, c) - 1 >= a / 2.0 AS h FROM c
    ), x AS (
        SELECT tid, v, h, coalesce(lead(v) OVER w, first_value(v) OVER w) AS next, coalesce(h <> lag(h) OVER w, true) AS starts FROM v WINDOW w AS (PARTITION BY tid ORDER BY i)
    ), y AS (
        SELECT tid, CAST(sum(v) AS BIGINT) AS sum, CAST(sum(v * v) AS BIGINT) AS square, CAST(sum(v * next) AS BIGINT) AS pair, CAST(count(*) FILTER (h) AS DOUBLE) AS high, count(*) FILTER (starts) AS runs FROM x GROUP BY tid
    ), q AS (SELECT tid, CAST(sum(k * k) AS DOUBLE) AS q FROM (SELECT tid, c, count(*) AS k FROM c GROUP BY tid, c) GROUP BY tid), z AS (
        SELECT t.*, CAST(t.n AS DOUBLE) AS r, s2 * s2 * {THIRD} AS s3, q.q, y.high * 2 * (t.n - y.high) / t.n AS more, y.runs,
               CAST(t.n * y.pair - y.sum * y.sum AS DOUBLE) AS over, CAST(t.n * y.square - y.sum * y.sum AS DOUBLE) AS under
        FROM t JOIN y USING (tid) JOIN q USING (tid)
    ), f AS (
        SELECT *, CASE WHEN more * (more - 1) / (r - 1) > 0 THEN (runs - more - 1) / sqrt(more * (more - 1) / (r - 1)) END AS run_z,
               CASE WHEN under > 0 THEN (over / under + 1.0 :: DOUBLE / (r - 1)) / (sqrt(r * (r - 3) / (r + 1)) / (r - 1)) END AS serial_z,
               (r + r * (r - 1) * s2 - q) / sqrt(r * 2 * (r - 1) * (s2 - s2 * s2 + (r - 2) * 2 * (s3 - s2 * s2))) AS far FROM z
    ), g AS (
        SELECT rn, s, e, {band} AS band, CASE WHEN coalesce(abs(run_z) <= {STRAY} AND abs(serial_z) <= {STRAY} AND far > 0, false) THEN exp(-far * far / 2) / 12 + exp(-far * far * 2 / 3) / 4 ELSE 1.0 :: DOUBLE END AS p FROM f
    ), j AS (
        SELECT *, CASE WHEN p > 0 THEN least({MOST_STEPS}, CAST(floor(log10(p) * -10) AS INTEGER)) ELSE {MOST_STEPS} END AS step FROM g
    ), k AS (
        SELECT band, min(step) AS least FROM (
            SELECT band, step, sum(count(*)) OVER (PARTITION BY band ORDER BY step DESC) AS so_far, sum(count(*)) OVER (PARTITION BY band) AS total FROM j GROUP BY band, step
        ) WHERE pow(10, -step / 10.0 :: DOUBLE) <= {FALSE_SHARE} * so_far / total GROUP BY band
    ), u AS (
        SELECT rn, kind, s, e FROM b UNION ALL
        SELECT j.rn, 3, j.s, j.e FROM j JOIN k ON j.band = k.band AND j.step >= k.least WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.rn = j.rn AND b.s <= j.s AND b.e >= j.e)
    ), o AS (
        SELECT rn, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2,
               string_agg({span}, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg({span}, ',' ORDER BY s, kind) AS spans FROM u GROUP BY rn
    )
    SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN o USING (rn)"""


NEGATIVES_SQL = """
    WITH v AS (
        SELECT row_number() OVER () AS rn, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS vector
        FROM embeddings
        WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    ), s AS (
        SELECT a.rn, a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, CAST(list_dot_product(a.vector, c.vector) AS BIGINT) AS score
        FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
    ), p AS (
        SELECT * FROM (SELECT rn, anchor_id, vec_id, score, row_number() OVER (PARTITION BY rn ORDER BY score DESC, vec_id) AS place FROM s WHERE same) WHERE place <= 5
    ), n AS (
        SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.rn, p.place ORDER BY s.score DESC, s.vec_id) AS rank,
               s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
        FROM p JOIN s ON p.rn = s.rn AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
    )
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").filter(usable(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows.select("vec_id", label.alias("label"), scaled(F.col("embedding"), 256).alias("vector")), F.col("vec_id") % 100 == 0)


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read_table(spark, sf_dir, "documents"))


QUERIES = {"op11_hard_negatives": op11_hard_negatives, "op12_secret_scan": op12_secret_scan, "op13_merkle_manifest": op13_merkle_manifest}
ORACLE_SQL = {"op11_hard_negatives": NEGATIVES_SQL, "op12_secret_scan": _secrets_sql(), "op13_merkle_manifest": _manifest_sql()}
