"""Queries for text preparation, chunking and extraction."""

from pyspark.sql import functions as F

from chartmill.functions import scalar as S
from chartmill.operators import extract as E
from chartmill.operators import text as T
from chartmill.plans.catalog import query
from chartmill.plans.sqltext import half, pct, q, words

_WS = r"\s+"


def _strip(e):
    return rf"regexp_replace({e}, '^\s+|\s+$', '', 'g')"


_CLEAN = "html"
for _p, _r in [
    (r"\n\s*\n\s*\n+", r"\n\n"), (r"[ \t]+", " "), (r" *\n *", r"\n"), (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), ("�", " "),
    (r"([.!?])\s*([A-Z])", r"\1 \2"), (r"([a-z])([A-Z])", r"\1 \2"), (r"(\d+)\s*[-/]\s*(\d+)\s*[-/]\s*(\d+)", r"\1/\2/\3"),
]:
    _rep = "chr(10) || chr(10)" if _r == r"\n\n" else "chr(10)" if _r == r"\n" else q(_r)
    _CLEAN = f"regexp_replace({_CLEAN}, {q(_p)}, {_rep}, 'g')"


@query("clean_page_text", f"SELECT page_id, sha256({_strip(_CLEAN)}) AS text_hash, length({_strip(_CLEAN)}) AS n FROM pages")
def _(t):
    c = T.clean_page_text(F.col("html"))
    return t.pages.withColumn("c", c).select("page_id", F.sha2("c", 256).alias("text_hash"), F.length("c").cast("bigint").alias("n"))


@query("collapse_whitespace", r"SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS text_hash FROM notes")
def _(t):
    return t.notes.select("doc_id", F.sha2(T.collapse_whitespace(F.col("text")), 256).alias("text_hash"))


_SENT_TEXT = "'Seen by Dr. ' || source || '. Took 5 mg. daily, i.e. often! ' || text"
_SENT = r"regexp_split_to_array(replace(replace(regexp_replace(x, '\b(Dr|Mr|Mrs|Ms|vs|etc|i\.e|e\.g|mg|ml|cc|mcg)\.', '\1~PERIOD~', 'g'), 'i.e~', 'i~PERIOD~e~'), 'e.g~', 'e~PERIOD~g~'), '[.!?]+\s+')"


@query(
    "sentence_split",
    f"""WITH s AS (SELECT doc_id, unnest({_SENT}) AS p, generate_subscripts({_SENT}, 1) AS i FROM (SELECT doc_id, {_SENT_TEXT} AS x FROM documents)),
        k AS (SELECT doc_id, i, replace(p, '~PERIOD~', '.') || '. ' AS sentence FROM s WHERE {_strip('p')} <> '')
        SELECT doc_id, count(*) AS sentences, max(length(sentence)) AS longest, sha256(string_agg(sentence, '|' ORDER BY i)) AS all_hash FROM k GROUP BY 1""",
)
def _(t):
    s = T.sentences(F.expr(_SENT_TEXT))
    return t.documents.select("doc_id", s.alias("s")).select(
        "doc_id", F.size("s").cast("bigint").alias("sentences"), F.array_max(F.transform("s", lambda x: F.length(x))).cast("bigint").alias("longest"),
        F.sha2(F.array_join("s", "|"), 256).alias("all_hash"),
    )


def _chunk_sql(text):
    """Check query of chunks of 2000 characters with 200 of overlap: one recursion step a sentence."""
    split = _SENT.replace("(x,", "(text,")
    return f"""RECURSIVE s AS (SELECT doc_id, unnest({split}) AS p, generate_subscripts({split}, 1) AS i FROM documents WHERE length(text) > 2000),
        k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, replace(p, '~PERIOD~', '.') || '. ' AS sentence FROM s WHERE {_strip('p')} <> ''),
        d AS (SELECT documents.doc_id, text, CAST(length(text) AS BIGINT) AS chars, coalesce(j.joined, '') AS joined, coalesce(j.n, 0) AS n FROM documents
              LEFT JOIN (SELECT doc_id, string_agg(sentence, '' ORDER BY i) AS joined, count(*) AS n FROM k GROUP BY 1) j ON j.doc_id = documents.doc_id WHERE length(text) > 2000),
        f AS (SELECT doc_id, chars, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS upto, CAST(0 AS BIGINT) AS filled, CAST(NULL AS BIGINT) AS cut FROM d
              UNION ALL SELECT f.doc_id, chars, k.i, upto + length(sentence),
                     CASE WHEN filled > 0 AND filled + length(sentence) > 2000 THEN greatest(0, least(chars, upto) - greatest(0, upto - 200)) + length(sentence) ELSE filled + length(sentence) END,
                     CASE WHEN filled > 0 AND filled + length(sentence) > 2000 THEN upto END FROM f JOIN k ON k.doc_id = f.doc_id AND k.i = f.i + 1),
        c AS (SELECT doc_id, cut FROM f WHERE cut IS NOT NULL UNION ALL SELECT f.doc_id, upto FROM f JOIN d ON d.doc_id = f.doc_id AND f.i = d.n),
        o AS (SELECT doc_id, cut, row_number() OVER w - 1 AS chunk_id, coalesce(lag(cut) OVER w, 0) AS before, lead(cut) OVER w IS NULL AS ends FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY cut)),
        t AS (SELECT o.*, joined, CASE WHEN chunk_id > 0 THEN {_tail('before')} ELSE '' END AS carried, CASE WHEN NOT ends THEN {_tail('cut')} END AS overlap_text FROM o JOIN d ON d.doc_id = o.doc_id)
        SELECT doc_id, 0 AS chunk_id, 0 AS start_index, length(text) AS end_index, text AS {text}, NULL AS overlap_text FROM documents WHERE length(text) <= 2000
        UNION ALL SELECT doc_id, chunk_id, before - length(carried), cut, carried || substring(joined, before + 1, cut - before), overlap_text FROM t WHERE cut > 0"""


def _tail(before):
    return f"substring(text, greatest(0, {before} - 200) + 1, greatest(0, {before} - greatest(0, {before} - 200)))"


@query("chunk_documents", "WITH " + _chunk_sql("text"))
def _(t):
    return T.chunk_documents(t.documents, 2000, 200)


@query("section_chunks")
def _(t):
    return T.section_chunks(t.notes, 4000, 200)


def _count(pattern):
    return f"len(regexp_extract_all(text, {q(pattern)}))"


@query(
    "section_marker_counts",
    " UNION ALL ".join(f"SELECT doc_id, '{n}' AS marker, {' + '.join(_count(p) for p in ps)} AS hits FROM notes" for n, ps in T.SECTION_MARKERS.items()),
)
def _(t):
    return T.marker_counts(t.notes)


@query(
    "significant_breaks",
    f"""WITH b AS (SELECT doc_id, text, instr(text, chr(10) || chr(10)) AS p FROM notes)
        SELECT doc_id, regexp_matches(substr({_strip('substr(text, p, 100)')}, 1, 50), {q(T.SIGNIFICANT_WORDS)}) AS significant FROM b WHERE p > 0""",
)
def _(t):
    rows = t.notes.withColumn("p", F.position(F.lit("\n\n"), F.col("text"))).filter("p > 0")
    return rows.select("doc_id", T.significant_break(F.col("text"), F.col("p") - 1).alias("significant"))


@query("text_size_gate", "SELECT doc_id, CASE WHEN length(text) > 8000 THEN 'failed' ELSE 'ok' END AS outcome FROM documents")
def _(t):
    return T.size_gate(t.documents, 8000).select("doc_id", "outcome")


@query("chunk_count_gate", "SELECT conv_id AS doc_id, count(*) AS chunks, CASE WHEN count(*) > 5 THEN 'failed' ELSE 'ok' END AS outcome FROM conversations GROUP BY 1")
def _(t):
    return T.chunk_count_gate(t.conversations.withColumnRenamed("conv_id", "doc_id"), 5)


@query(
    "text_quality_gate",
    f"""SELECT doc_id, CASE WHEN {_strip('text')} = '' THEN 'empty' ELSE concat_ws(';', CASE WHEN length({_strip('text')}) < 50 THEN 'too short' END, """
    + ", ".join(f"CASE WHEN contains(lower(text), '{p}') THEN 'error: {p}' END" for p in T.ERROR_PHRASES)
    + ", CASE WHEN " + " + ".join(f"contains(lower(text), '{w}')::INT" for w in T.MEDICAL_WORDS) + " < 2 THEN 'limited medical content' END) END AS issues FROM documents",
)
def _(t):
    return t.documents.select("doc_id", F.array_join(T.quality_issues(F.col("text")), ";").alias("issues"))


@query(
    "text_method",
    """WITH p AS (SELECT source, count(*) FILTER (n_chars > 600) AS text_pages, count(*) FILTER (n_chars <= 600) AS image_pages FROM documents GROUP BY source, lang)
       SELECT text_pages, image_pages, CASE WHEN image_pages = 0 THEN 'embedded_text' WHEN text_pages = 0 THEN 'ocr' ELSE 'hybrid' END AS method FROM p""",
)
def _(t):
    pages = t.documents.select(F.concat_ws("/", "source", "lang").alias("doc_id"), (F.col("n_chars") > 600).alias("has_text"))
    return T.text_method(pages).drop("doc_id")


_BLOCKS = """SELECT l_orderkey AS doc_id, l_linenumber % 3 + 1 AS page, CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS block_id,
   CASE l_suppkey % 9 WHEN 0 THEN 'PAGE' WHEN 1 THEN 'TABLE' WHEN 2 THEN 'KEY_VALUE_SET' WHEN 3 THEN 'WORD' WHEN 4 THEN 'WORD' ELSE 'LINE' END AS block_type,
   CASE WHEN l_partkey % 20 = 0 THEN '' ELSE 'w' || CAST(l_partkey AS STRING) END AS text, CAST(l_partkey % 40 AS DOUBLE) / 1000 AS top, CAST(l_suppkey AS DOUBLE) / 1000 AS left_edge, l_quantity * 2 - 4 AS confidence FROM lineitem"""


def _blocks(t):
    rows = t.sql(_BLOCKS).withColumnRenamed("left_edge", "left")
    words = rows.filter("block_type = 'WORD' AND left < 0.05").select("doc_id", "page", F.col("block_id").alias("w"))
    lines = rows.filter("block_type = 'LINE'").groupBy("doc_id", "page").agg(F.min("block_id").alias("block_id"))
    kids = words.join(lines, ["doc_id", "page"]).groupBy("doc_id", "page", "block_id").agg(F.collect_list("w").alias("children"))
    return rows.join(kids, ["doc_id", "page", "block_id"], "left").withColumn("children", F.coalesce("children", F.array().cast("array<string>")))


@query(
    "page_fragments",
    f"""WITH b AS ({_BLOCKS}) SELECT doc_id, page, block_id, text FROM b WHERE text <> '' AND (block_type = 'LINE' OR (block_type = 'WORD' AND NOT (left_edge < 0.05
          AND EXISTS (SELECT 1 FROM b l WHERE l.doc_id = b.doc_id AND l.page = b.page AND l.block_type = 'LINE'))))""",
)
def _(t):
    return T.page_fragments(_blocks(t)).select("doc_id", "page", "block_id", "text")


@query(
    "page_line_texts",
    f"WITH b AS ({_BLOCKS}) SELECT doc_id, page, string_agg(text, chr(10) ORDER BY top, left_edge, text) AS text FROM b WHERE block_type = 'LINE' AND text <> '' GROUP BY ALL",
)
def _(t):
    return T.page_texts(_blocks(t))


@query(
    "page_lines",
    f"""WITH RECURSIVE b AS ({_BLOCKS}), x AS (SELECT doc_id, page, CAST(round(top * 1000000) AS BIGINT) AS t, left_edge, text FROM b
           WHERE text <> '' AND (block_type = 'LINE' OR (block_type = 'WORD' AND NOT (left_edge < 0.05 AND EXISTS (SELECT 1 FROM b l WHERE l.doc_id = b.doc_id AND l.page = b.page AND l.block_type = 'LINE'))))),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY t, left_edge, text) AS i FROM x),
        f AS (SELECT doc_id, page, i, t AS top, 1 AS line, text FROM r WHERE i = 1
              UNION ALL SELECT r.doc_id, r.page, r.i, CASE WHEN r.t - f.top <= 10000 THEN f.top ELSE r.t END, CASE WHEN r.t - f.top <= 10000 THEN line ELSE line + 1 END, r.text
              FROM f JOIN r ON r.doc_id = f.doc_id AND r.page = f.page AND r.i = f.i + 1),
        w AS (SELECT doc_id, page, line, trim(string_agg(text, ' ' ORDER BY i)) AS text FROM f GROUP BY ALL)
        SELECT doc_id, page, coalesce(string_agg(text, chr(10) ORDER BY line) FILTER (text <> ''), '') AS text FROM w GROUP BY ALL""",
)
def _(t):
    return T.page_lines(T.page_fragments(_blocks(t)))


@query(
    "combined_recognition",
    f"""WITH b AS ({_BLOCKS}) SELECT doc_id, greatest(1, count(*) FILTER (block_type = 'PAGE')) AS pages, count(*) AS blocks,
          coalesce({half("avg(confidence) FILTER (block_type IN ('LINE', 'WORD') AND confidence > 0)", 2)}, 0) AS confidence,
          count(*) FILTER (block_type = 'TABLE') AS tables, count(*) FILTER (block_type = 'KEY_VALUE_SET') AS forms FROM b GROUP BY 1""",
)
def _(t):
    return T.combined_result(_blocks(t))


# ---------------------------------------------------------------- extraction
@query("extract_dates")
def _(t):
    hits = E.extract_dates(t.notes, "2024-06-15")
    with_text = hits.join(t.notes.select("doc_id", "text"), "doc_id")
    return with_text.select("doc_id", "position", "raw", "day", "confidence", "method", E.context_window(F.col("text"), F.col("position")).alias("context"))


@query(
    "date_mentions",
    "SELECT doc_id, " + ", ".join(f"{_count(E.DATE_FAMILIES[i][0])} AS {n}" for i, n in [(1, "ymd"), (0, "slash"), (3, "month_name")]) + " FROM notes",
)
def _(t):
    return E.date_mentions(t.notes)


@query(
    "context_window",
    "SELECT doc_id, substr(text, greatest(0, p - 50) + 1, p + 100 - greatest(0, p - 50)) AS context FROM (SELECT doc_id, text, doc_id % 200 AS p FROM documents)",
)
def _(t):
    return t.documents.select("doc_id", E.context_window(F.col("text"), (F.col("doc_id") % 200).cast("int")).alias("context"))


def _first(patterns, group=1, col="text"):
    return "coalesce(" + ", ".join(f"CASE WHEN regexp_matches({col}, {q(p)}) THEN regexp_extract({col}, {q(p)}, {group}) END" for p in patterns) + ")"


_PF = {k: _strip(_first(p)) for k, (_, p) in E.PATIENT_FIELDS.items()}
_PF["sex"] = f"CASE WHEN upper({_PF['sex']}) IN ('M', 'MALE') THEN 'Male' WHEN upper({_PF['sex']}) IN ('F', 'FEMALE') THEN 'Female' ELSE upper({_PF['sex']}) END"


@query(
    "patient_fields",
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS label, {_PF[k]} AS value, {c}::DOUBLE AS confidence FROM notes" for k, (c, _) in E.PATIENT_FIELDS.items()) + ") WHERE value IS NOT NULL",
)
def _(t):
    return E.patient_fields(t.notes)


@query(
    "fallback_fields",
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS label, {_strip(_first(p))} AS value FROM notes" for k, p in E.FALLBACK_FIELDS.items()) + ") WHERE value IS NOT NULL",
)
def _(t):
    return E.fallback_fields(t.notes)


@query(
    "fallback_lists",
    "SELECT DISTINCT doc_id, kind, " + _strip("v") + " AS value FROM ("
    + " UNION ALL ".join(f"SELECT doc_id, 'medication' AS kind, unnest(regexp_extract_all(text, {q(p)})) AS v FROM notes" for p in E.FALLBACK_MEDICATION)
    + " UNION ALL " + " UNION ALL ".join(f"SELECT doc_id, 'diagnosis' AS kind, unnest(regexp_extract_all(text, {q(p)}, 1)) AS v FROM notes" for p in E.FALLBACK_DIAGNOSIS) + ")",
)
def _(t):
    return E.fallback_lists(t.notes)


@query(
    "diagnosis_sections",
    f"""SELECT doc_id, 0 AS ord, 'Preoperative: ' || {_strip("regexp_extract(text, '(?s)PREOPERATIVE DIAGNOSIS:(.*?)(?:POSTOPERATIVE|PROCEDURE|$)', 1)")} AS diagnosis FROM notes""",
)
def _(t):
    return E.diagnoses(t.notes)


@query(
    "medication_lines",
    f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, i) - 1 AS ord, {_strip('v')} AS medication FROM (SELECT doc_id, 1 AS k, unnest(m) AS v, generate_subscripts(m, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, {q(E.MEDICATION_LINES[0])}, 1) AS m FROM notes)
          UNION ALL SELECT doc_id, 2, unnest(m), generate_subscripts(m, 1) FROM (SELECT doc_id, regexp_extract_all(text, {q(E.MEDICATION_LINES[1])}, 1) AS m FROM notes))""",
)
def _(t):
    return E.medication_lines(t.notes)


@query(
    "allergy_items",
    rf"""WITH l AS (SELECT doc_id, regexp_split_to_array({_strip(_first(E.ALLERGY_LINES))}, '[,;]\s*') AS m FROM notes) SELECT doc_id, CAST(generate_subscripts(m, 1) - 1 AS INT) AS ord, {_strip('unnest(m)')} AS allergy FROM l""",
)
def _(t):
    return E.allergies(t.notes)


_KV = r"unnest(regexp_extract_all(text, '([A-Za-z][A-Za-z0-9\s]*?):\s*([^:\n]+)', {}))"


@query(
    "key_value_fields",
    rf"""WITH p AS (SELECT doc_id, {_strip(_KV.format(1))} AS label, {_strip(_KV.format(2))} AS value FROM notes)
        SELECT doc_id, label, value, 0.7::DOUBLE AS confidence FROM p WHERE length(label) >= 2 AND length(value) >= 1""",
)
def _(t):
    return E.key_value_fields(t.notes)


_BODY = """'{"patient_name": {"value": "P' || CAST(event_id AS STRING) || '", "confidence": 0.75, "source_text": "near"}, "sex": "F", "n": ' || CAST(event_id AS STRING) || '}'"""
_ANSWERS = f"""SELECT event_id AS doc_id, CASE event_id % 5 WHEN 0 THEN {_BODY} WHEN 1 THEN '```json ' || {_BODY} || ' ```' WHEN 2 THEN 'Here you are: ```' || {_BODY} || '``` done'
   WHEN 3 THEN 'Name: Jane Doe' ELSE 'nothing here' END AS text FROM events"""


@query(
    "answer_strategies",
    "SELECT event_id AS doc_id, CASE event_id % 5 WHEN 0 THEN 'direct' WHEN 1 THEN 'sanitized' WHEN 2 THEN 'code_block' WHEN 3 THEN 'key_value' ELSE 'patterns' END AS strategy FROM events",
)
def _(t):
    return E.parse_answers(t.sql(_ANSWERS)).select("doc_id", "strategy")


@query(
    "answer_fields",
    """SELECT event_id AS doc_id, 'patient_name' AS label, 'P' || event_id AS value, 0.75::DOUBLE AS confidence, 'near' AS source_text FROM events WHERE event_id % 5 < 3
       UNION ALL SELECT event_id, 'sex', 'F', 0.9, '' FROM events WHERE event_id % 5 < 3 UNION ALL SELECT event_id, 'n', CAST(event_id AS STRING), 0.9, '' FROM events WHERE event_id % 5 < 3""",
)
def _(t):
    return E.answer_fields(E.parse_answers(t.sql(_ANSWERS)))


_DIAG = """SELECT encounter_id AS doc_id, CASE encounter_id % 6 WHEN 0 THEN 'EKG 01/02/2023 shows normal sinus rhythm' WHEN 1 THEN 'Chest x-ray: clear lungs' WHEN 2 THEN 'Iron level 2023-04-05 result: 80'
   WHEN 3 THEN 'CT scan reveals mass' WHEN 4 THEN 'Bone density scan pending review' ELSE 'urinalysis' END AS item, CASE WHEN encounter_id % 6 = 4 THEN 'imaging' ELSE 'lab_result' END AS context FROM encounters"""


@query(
    "diagnostic_text_parse",
    """SELECT encounter_id AS doc_id, CASE encounter_id % 6 WHEN 0 THEN 'ekg' WHEN 1 THEN 'chest x-ray' WHEN 2 THEN 'Iron test' WHEN 3 THEN 'ct scan' WHEN 4 THEN 'Imaging study' ELSE 'urinalysis' END AS procedure_type,
         CASE encounter_id % 6 WHEN 0 THEN '01/02/2023' WHEN 2 THEN '23-04-05' END AS date,
         CASE encounter_id % 6 WHEN 0 THEN 'normal sinus rhythm' WHEN 1 THEN 'clear lungs' WHEN 2 THEN '80' WHEN 3 THEN 'mass' WHEN 4 THEN 'bone density scan pending review' END AS conclusion FROM encounters""",
)
def _(t):
    return t.sql(_DIAG).select("doc_id", E.parse_diagnostic(F.col("item"), F.col("context")).alias("p")).select("doc_id", "p.*")


_REQS = """SELECT encounter_id AS doc_id, CASE encounter_id % 5 WHEN 0 THEN 'Urgent cardiology consult for chest pain. Done.' WHEN 1 THEN 'Refer to Dr House in 2 weeks. Routine' WHEN 2 THEN 'Order MRI brain due to headache. Then see primary care.'
   WHEN 3 THEN 'Follow-up with PCP next month' ELSE 'Rest and fluids' END AS text FROM encounters"""


@query(
    "service_request_parse",
    """SELECT encounter_id AS doc_id, CASE encounter_id % 5 WHEN 0 THEN 'cardiology' WHEN 1 THEN 'dr house in 2 weeks' WHEN 2 THEN 'mri brain due to headache' WHEN 3 THEN 'pcp next month' ELSE 'Rest and fluids' END AS service,
         CASE encounter_id % 5 WHEN 0 THEN 'urgent' WHEN 1 THEN 'in 2 weeks' WHEN 3 THEN 'next month' END AS date, CASE WHEN encounter_id % 5 = 0 THEN 'urgent' ELSE 'routine' END AS priority,
         CASE encounter_id % 5 WHEN 0 THEN 'chest pain' WHEN 2 THEN 'headache' END AS reason FROM encounters""",
)
def _(t):
    return t.sql(_REQS).select("doc_id", E.parse_service_request(F.col("text")).alias("p")).select("doc_id", "p.*")


@query(
    "plan_requests",
    """SELECT encounter_id AS doc_id, 0 AS ord, CASE encounter_id % 5 WHEN 1 THEN 'Dr House in 2 weeks' WHEN 2 THEN 'MRI brain due to headache' ELSE 'PCP next month' END AS service FROM encounters WHERE encounter_id % 5 IN (1, 2, 3)
       UNION ALL SELECT encounter_id, 1, 'primary care' FROM encounters WHERE encounter_id % 5 = 2""",
)
def _(t):
    return E.plan_requests(t.sql(_REQS))


_KW = ["the", "ast", "eauo", "und", "mrn", "obesity"]


@query("keyword_whole_word", f"SELECT doc_id, {words('text', _KW)} AS hit, {words('text', ['ast', 'diagnosi'])} AS rare FROM notes")
def _(t):
    return t.notes.select("doc_id", S.has_word(F.col("text"), _KW).alias("hit"), S.has_word(F.col("text"), ["ast", "diagnosi"]).alias("rare"))


@query(
    "vaccine_name_with_claims",
    """SELECT encounter_id, encounter_id % 4 IN (0, 1, 2) AS vaccine FROM encounters""",
)
def _(t):
    name = F.expr("CASE encounter_id % 4 WHEN 0 THEN 'Flu shot' WHEN 1 THEN 'Jynneos dose two' WHEN 2 THEN 'hepatitis series' ELSE 'reflux surgery td' END")
    return t.encounters.select("encounter_id", S.is_vaccine(name, F.array(F.lit(" jynneos "), F.lit("td"), F.lit(None).cast("string"))).alias("vaccine"))


_TARGET = """SELECT doc_id, text, CASE doc_id % 5 WHEN 0 THEN substr(text, 60, 25) WHEN 1 THEN 'mrn: ' || CAST(1000000 + doc_id AS STRING) WHEN 2 THEN 'unknown, twice daily, xx' WHEN 3 THEN 'Sex-linked' ELSE 'qqqq' END AS value FROM notes"""
_AT = """CASE doc_id % 5 WHEN 0 THEN instr(text, value) WHEN 1 THEN instr(lower(text), value) WHEN 2 THEN instr(lower(text), 'twice daily') ELSE 0 END - 1"""


@query(
    "snippet_window",
    rf"""WITH t AS ({_TARGET}), p AS (SELECT *, {_AT} AS position FROM t) SELECT doc_id, position, position >= 0 AS found,
          CASE WHEN position < 0 THEN '' ELSE trim(regexp_replace(substr(text, greatest(0, position - 150) + 1, least(length(text), position + length(value) + 150) - greatest(0, position - 150)), '\s+', ' ', 'g')) END AS snippet FROM p""",
)
def _(t):
    return E.snippets(t.sql(_TARGET)).select("doc_id", F.col("position").cast("bigint").alias("position"), "found", "snippet")


@query(
    "snippet_positions",
    f"""WITH t AS ({_TARGET}), p AS (SELECT *, {_AT} AS p FROM t), h AS (SELECT doc_id, p, substr(text, 1, CAST(p AS BIGINT)) AS head FROM p WHERE p >= 0)
        SELECT doc_id, len(regexp_extract_all(head, chr(10))) + 1 AS line, length(string_split(head, chr(10))[-1]) + 1 AS col FROM h""",
)
def _(t):
    rows = E.snippets(t.sql(_TARGET)).filter("found")
    return rows.select("doc_id", E.line_and_column(F.col("text"), F.col("position")).alias("lc")).select(
        "doc_id", F.col("lc.line").cast("bigint").alias("line"), F.col("lc.column").cast("bigint").alias("col")
    )


_SNIP = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN substr(text, 1, 30) WHEN 2 THEN substr(text, 1, 300) ELSE text END AS source_text, CAST(doc_id % 3 - 1 AS INT) AS position FROM documents"


@query(
    "snippet_issues",
    f"""WITH s AS ({_SNIP}) SELECT doc_id, concat_ws(';', CASE WHEN {_strip('source_text')} = '' THEN 'empty' END, CASE WHEN length(source_text) < 50 AND {_strip('source_text')} <> '' THEN 'short' END,
          CASE WHEN length(source_text) > 500 THEN 'long' END, CASE WHEN position < 0 THEN 'negative position' END) AS issues FROM s""",
)
def _(t):
    return t.sql(_SNIP).select("doc_id", F.array_join(E.snippet_issues(F.col("source_text"), F.col("position")), ";").alias("issues"))


@query(
    "truncate_snippets",
    r"""WITH h AS (SELECT doc_id, text, substr(text, 1, 200) AS head FROM documents), w AS (SELECT *, regexp_replace(head, '(?s) [^ ]*$', '') AS cut FROM h)
        SELECT doc_id, CASE WHEN length(text) <= 200 THEN text WHEN contains(head, ' ') AND length(cut) > 160 THEN cut || '...' ELSE head || '...' END AS snippet FROM w""",
)
def _(t):
    return t.documents.select("doc_id", E.truncate_snippet(F.col("text")).alias("snippet"))


@query(
    "snippet_statistics",
    f"""WITH s AS ({_SNIP}), g AS (SELECT doc_id % 50 AS doc_id, source_text AS snippet, CASE WHEN position >= 0 THEN position END AS position FROM s)
        SELECT doc_id, count(*) AS snippets, {half('avg(length(snippet))', 1)} AS avg_length, count(position) AS with_position, count(*) FILTER ({_strip('snippet')} = '') AS empty,
          {pct('count(position)', 'count(*)')} AS position_coverage, {pct(f"count(*) FILTER ({_strip('snippet')} <> '')", 'count(*)')} AS content_coverage FROM g GROUP BY 1""",
)
def _(t):
    rows = t.sql(_SNIP).selectExpr("doc_id % 50 AS doc_id", "source_text AS snippet", "CASE WHEN position >= 0 THEN position END AS position")
    return E.snippet_stats(rows)


@query("chunk_table_function", "WITH " + _chunk_sql("chunk_text"))
def _(t):
    from chartmill.functions.udfs import register

    register(t.spark)
    rows = t.documents.select("doc_id", "text", T.sentences(F.col("text")).alias("pieces"))
    return t.spark.sql("SELECT doc_id, c.* FROM {rows}, LATERAL sentence_chunks(text, pieces, 2000, 200) AS c", rows=rows)
