"""Clinical roles played by the driver's tables.

Every role is one projection written in SQL that Spark and an ANSI engine read
alike, so a query and its check start from the same rows. A role may use base
tables and earlier roles. Roles grow with the tables they come from.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from chartmill.session import ship_package

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def pick(key: str, values: list[str]) -> str:
    """CASE expression choosing one of ``values`` by an integer key."""
    whens = " ".join(
        f"WHEN {i} THEN '{v.replace(chr(39), chr(39) * 2)}'" for i, v in enumerate(values)
    )
    return f"CASE ({key}) % {len(values)} {whens} END"


FIRST = ["Anna", "Bernd", "Clara", "Daniel", "Élodie", "Frank", "O'neil", "Anne-Marie"]
LAST = ["Meyer", "Mayer", "Meier", "Smith", "Smyth", "Brown", "van Dyk", "Schmidt", "Okafor", "Li", "Ng"]
DRUGS = [
    "Lisinopril", "Metformin", "Atorvastatin", "Insulin glargine", "Albuterol inhaler",
    "Omeprazole", "Warfarin", "Sertraline", "Unlisted Herbal", "Gabapentin capsule",
]
TESTS = [
    "Glucose", "Creatinine", "Hemoglobin A1c", "Total Cholesterol", "HDL", "Triglycerides",
    "Blood Pressure", "Heart Rate", "Tobacco use", "Skin appearance", "Sodium", "TSH",
]
LOINCS = [
    "2345-7", "2160-0", "4548-4", "2093-3", "2085-9", "2571-8",
    "85354-9", "8867-4", "72166-2", "39107-8", "2951-2", "3016-3",
]
LABELS = [
    "Patient Name", "Date of Birth", "MRN", "Gender", "Diagnosis_1", "diagnosis_2",
    "medication_list", "Lab_glucose", "Blood level", "vital_bp", "procedure_name",
    "Allergy reaction", "provider_name", "Admission date", "Phone", "Comment",
]
CONDITIONS = [
    "1. Type 2 Diabetes (controlled)", "Essential Hypertension", "2) Asthma  (mild)",
    "Coronary artery disease", "Abnormal thyroid", "Obesity",
]
ICD = ["E11.9", "I10", "J45", "I25.10", "E07.9", "E66"]

# columns of the roles that rows of ``LINES`` play
LINES = "lineitem JOIN orders ON l_orderkey = o_orderkey"
OBSERVATION = f"""CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' ||
               CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS obs_id,
               o_custkey AS patient_id, l_orderkey AS encounter_id, l_partkey AS code_id,
               {pick('l_partkey', TESTS)} AS test_name, {pick('l_partkey', LOINCS)} AS loinc,
               l_quantity AS value, {pick('l_suppkey', ['mg/dL', 'mmol/L', ''])} AS unit,
               l_shipdate AS effective_at, CAST(l_shipdate AS DATE) AS effective_date,
               l_returnflag AS flag, l_linestatus AS line_status, l_suppkey AS source_id,
               l_linenumber AS line_no, l_discount AS confidence_gap,
               CASE l_linenumber % 3 WHEN 0 THEN l_orderkey END AS encounter_ref,
               CASE WHEN l_linenumber % 3 = 2 AND l_partkey % 5 = 0
                    THEN substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 7)
                    WHEN l_linenumber % 3 = 2 AND l_partkey % 5 = 1 THEN NULL
                    WHEN l_linenumber % 3 = 2 AND l_partkey % 5 = 2
                    THEN CAST(CAST(l_shipdate AS DATE) AS STRING)
                    ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS date_text"""
CONDITION = f"""CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' ||
               CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS condition_id,
               o_custkey AS patient_id, l_orderkey AS encounter_id,
               {pick('l_partkey', CONDITIONS)} AS name, {pick('l_partkey', ICD)} AS code,
               {pick('l_suppkey', ['active', 'resolved', 'inactive', 'chronic'])} AS status,
               {pick('l_linenumber', ['mild', 'moderate', 'severe'])} AS severity,
               {pick('l_suppkey', ['documented', 'inferred', 'documented', 'inferred', 'documented'])} AS evidence,
               CASE l_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN substr(CAST(CAST(l_shipdate AS DATE) AS STRING), 1, 7)
                    ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END AS onset_text,
               l_shipdate AS updated_at, l_suppkey AS source_id,
               CAST(1.0 - l_discount AS DOUBLE) AS confidence"""
MEDICATION = f"""CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' ||
               CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS med_id,
               o_custkey AS patient_id, l_orderkey AS encounter_id,
               {pick('l_partkey', DRUGS)} AS name,
               CAST(CAST(l_quantity AS INT) % 4 * 5 + 5 AS STRING) || ' mg' AS dose,
               {pick('l_suppkey', ['once daily', 'twice daily', 'BID by mouth', 'as needed', 'every 6 hours'])} AS schedule,
               {pick('l_suppkey', ['active', 'stopped', 'completed', 'on-hold'])} AS status,
               CAST(CAST(l_shipdate AS DATE) AS STRING) AS start_date,
               {pick('l_partkey', DRUGS)} || ' ' || CAST(CAST(l_quantity AS INT) % 4 * 5 + 5 AS STRING) ||
               {pick('l_suppkey', [' mg', ' mcg', ' units'])} ||
               {pick('l_linenumber', [' twice daily by mouth', ' PO daily', ' every 6 hours', ' IV as needed', ' BID'])}
               AS sentence,
               l_suppkey AS source_id, l_linenumber AS line_no"""
# all roles of a row of ``LINES`` at once: an observation, and which others it is
IS_CONDITION, IS_MEDICATION = "l_returnflag = 'R'", "l_returnflag = 'A'"
LINE_ROLES = f"{IS_CONDITION} AS is_condition, {IS_MEDICATION} AS is_medication, {OBSERVATION}, struct({CONDITION}) AS of_conditions, struct({MEDICATION}) AS of_medications"

ROLES: dict[str, str] = {
    "patients": f"""
        SELECT c_custkey AS patient_id, 'MRN' || CAST(100000 + c_custkey AS STRING) AS mrn,
               {pick('c_custkey', FIRST)} AS first_name,
               {pick('CAST(floor(c_custkey / 8) AS BIGINT)', LAST)} AS last_name,
               DATE '1930-01-01' + CAST((c_custkey % 40) * 600 AS INT) AS birth_date,
               '1 (555) ' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') || '-' ||
               lpad(CAST((c_custkey * 7) % 10000 AS STRING), 4, '0') AS phone,
               {pick('c_custkey', ['male', 'female', 'F', 'unknown'])} AS gender,
               c_mktsegment AS living_setting, c_nationkey AS nation_id, c_name AS owner
        FROM customer""",
    "providers": f"""
        SELECT s_suppkey AS provider_id, s_name AS name, n_name AS specialty,
               CAST(n_regionkey AS STRING) AS organization,
               CAST(1000000000 + s_suppkey * 104729 AS STRING) AS npi,
               {pick('s_suppkey', ['Dr. ', '', 'Prof ', ''])} ||
               {pick('s_suppkey', ['Smith, John', 'Maria Lopez MD', 'Alan M Turing', 'Grace Hopper, RN', 'Dumas'])}
               AS full_name
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "codes": f"""
        SELECT p_partkey AS code_id, p_name AS display, p_type AS panel,
               CAST(p_size AS DOUBLE) * 0.5 AS low, CAST(p_size AS DOUBLE) AS high,
               {pick('p_partkey', TESTS)} AS test_name, {pick('p_partkey', LOINCS)} AS loinc,
               {pick('p_partkey', ['8480-6', 'E11.9', '44054006', '99213', 'mg/dL', 'e11', '123456', '???', 'Z51.11', ' 30934-4 '])}
               AS raw_code,
               {pick('p_partkey', ['lab test', 'diagnosis of', 'clinical finding', 'procedure note', 'unit', 'drug'])} AS context,
               {pick('p_size', ['LOINC', 'ICD-10', 'SNOMED', 'CPT', 'RxNorm', 'OTHER'])} AS stated_system
        FROM part""",
    "encounters": f"""
        SELECT o_orderkey AS encounter_id, o_custkey AS patient_id, o_orderstatus AS status,
               CAST(o_orderdate AS DATE) AS visit_date, o_orderdate AS started_at,
               CASE o_orderkey % 7 WHEN 0 THEN substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 7)
                                   WHEN 1 THEN substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 4)
                                   WHEN 2 THEN NULL
                                   ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS date_text,
               {pick('o_orderkey', ['AMB', 'IMP', 'EMER', 'HH', 'VR', 'other'])} AS enc_class,
               {pick('o_orderkey', ['Office visit', 'inpatient stay', 'Emergency department', 'telehealth call', 'fasting labs', 'hospital admission'])} AS type_text,
               {pick('o_orderkey', ['Main Clinic, Room 1', 'main clinic', 'East Ward, 3', ''])} AS location,
               o_orderpriority AS reason, o_totalprice AS amount
        FROM orders""",
    "observations": f"""
        SELECT {OBSERVATION}
        FROM {LINES}""",
    "results": """
        SELECT o.*, c.low, c.high, c.panel
        FROM observations o JOIN codes c ON o.code_id = c.code_id""",
    "conditions": f"""
        SELECT {CONDITION}
        FROM {LINES}
        WHERE l_returnflag = 'R'""",
    "medications": f"""
        SELECT {MEDICATION}
        FROM {LINES}
        WHERE l_returnflag = 'A'""",
    "fields": f"""
        SELECT l_orderkey AS doc_id, l_linenumber AS chunk, l_suppkey AS ord, l_partkey AS code_id,
               {pick('l_partkey + l_suppkey', LABELS)} AS label,
               CASE (l_partkey + l_suppkey) % 16
                    WHEN 0 THEN {pick('l_suppkey', ['dr jane  doe', 'X', "mary o'neil-smith jr", 'Dr. John Smith III'])}
                    WHEN 1 THEN {pick('l_suppkey', ['1980-02-30', '03/04/1981', '1979-12-01', 'DOB: 12-25-2023', 'soon'])}
                    WHEN 2 THEN 'MRN ' || CAST(l_orderkey AS STRING)
                    WHEN 4 THEN {pick('l_suppkey', CONDITIONS)}
                    WHEN 5 THEN {pick('l_partkey', CONDITIONS)}
                    WHEN 6 THEN {pick('l_suppkey', DRUGS)} || ' 10 MG daily'
                    WHEN 7 THEN CAST(l_quantity AS STRING)
                    WHEN 9 THEN CAST(CAST(l_quantity AS INT) + 90 AS STRING) || '/80'
                    WHEN 13 THEN CAST(CAST(l_shipdate AS DATE) AS STRING)
                    WHEN 14 THEN '1-555-010-' || lpad(CAST(l_suppkey % 10000 AS STRING), 4, '0')
                    ELSE 'value ' || CAST(l_partkey % 50 AS STRING) END AS value,
               CAST(0.4 + l_discount * 6 AS DOUBLE) AS confidence
        FROM lineitem""",
    "pipeline": f"""
        SELECT event_id AS doc_id, user_id AS patient_id, ts AS uploaded_at,
               CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'view' THEN 'completed'
                    WHEN 'error' THEN 'failed' WHEN 'click' THEN 'processing'
                    ELSE CASE WHEN event_id % 2 = 0 THEN 'pending' ELSE 'ocr_pending' END END AS status,
               ts + INTERVAL '1' SECOND * CAST(floor(value) AS INT) AS processed_at,
               CAST(floor(value * 10) AS BIGINT) AS queue_wait_ms,
               CAST(floor(value * 7) AS BIGINT) AS pdf_ms, CAST(floor(value * 30) AS BIGINT) AS ai_ms,
               CAST(floor(value * 3) AS BIGINT) AS fhir_ms, CAST(floor(value * 50) AS BIGINT) AS total_ms,
               {pick('event_id', ['Extracting PDF text', 'Analyzing with AI', 'Converting to FHIR', 'waiting', 'ai step', ''])} AS message,
               CAST(event_id % 5 AS INT) AS attempts,
               'scan_' || CAST(event_id % 97 AS STRING) || '.pdf' AS filename,
               CAST(event_id % 11 AS STRING) AS uploaded_by
        FROM events""",
    "usage_log": f"""
        SELECT event_id AS call_id, user_id AS session_id, event_id % 400 AS doc_id,
               user_id % 50 AS patient_id,
               CASE WHEN event_type IN ('click', 'view') THEN 'openai' WHEN event_type = 'signup' THEN 'aws_textract'
                    ELSE 'anthropic' END AS provider,
               CASE event_type WHEN 'click' THEN 'gpt-4' WHEN 'view' THEN 'GPT-3.5-turbo'
                    WHEN 'signup' THEN 'detect' WHEN 'purchase' THEN 'claude-3-haiku' ELSE 'retired-model' END AS model,
               CAST(floor(value * 20) AS BIGINT) AS input_tokens,
               CAST(floor(value * 5) AS BIGINT) AS output_tokens,
               ts AS started_at, CAST(floor(value * 40) AS BIGINT) AS duration_ms,
               event_id % 9 <> 0 AS success, event_id % 6 AS chunk_no
        FROM events""",
    "error_log": f"""
        SELECT event_id AS error_id, ts,
               {pick('event_id', ['AIServiceTimeoutError', 'PDFExtractionError', 'AIExtractionError', 'DocumentProcessingError', 'KeyError', 'ConnectionError'])} AS error_type,
               {pick('user_id', ['ai_service', 'pdf', 'merge', 'web'])} AS component,
               {pick('event_id + user_id', ['Rate limit reached, retry after 5', 'connection reset', 'invalid key', 'Malformed body', 'disk full', 'temporarily unavailable'])} AS message
        FROM events WHERE event_type = 'error'""",
    "audit_log": f"""
        SELECT event_id AS audit_id, ts AS logged_at, user_id,
               'user' || CAST(user_id AS STRING) AS username, event_type AS category,
               {pick('event_id', ['GET', 'POST', 'PUT', 'DELETE', 'PATCH'])} AS method,
               {pick('event_id + user_id', ['/patients/12/', '/Accounts/login/', '/documents/4', '/admin/x', '/api/health', '/reports/7/', '/logout'])} AS path,
               {pick('user_id', ['info', 'warning', 'error', 'critical'])} AS severity,
               '10.0.' || CAST(user_id % 8 AS STRING) || '.' || CAST(event_id % 200 AS STRING) AS ip_address,
               event_id % 13 <> 0 AS success, event_id % 4 = 0 AS phi_involved,
               event_type || ' on item ' || CAST(event_id % 300 AS STRING) AS description,
               CASE WHEN event_id % 3 = 0 THEN 'MRN' || CAST(100000 + user_id AS STRING) END AS patient_mrn,
               CAST(value AS DOUBLE) AS value
        FROM events""",
    "field_audit": f"""
        SELECT event_id AS change_id, ts AS created_at, user_id % 40 AS reviewer,
               event_id % 1500 AS patient_id,
               {pick('event_id', ['patient_name', 'date_of_birth', 'phone', 'address', 'mrn', 'diagnosis'])} AS field_name,
               event_type AS change_type, CAST(value / 400 AS DOUBLE) AS confidence,
               CAST(event_id % 100 AS INT) AS quality
        FROM events""",
    "resources": """
        SELECT 'Observation' AS resource_type, obs_id AS resource_id, patient_id, source_id,
               effective_at AS updated_at, CAST(1.0 - confidence_gap AS DOUBLE) AS confidence,
               loinc AS code, CAST(value AS STRING) AS body FROM observations
        UNION ALL
        SELECT 'Condition', condition_id, patient_id, source_id, updated_at, confidence, code, status
        FROM conditions
        UNION ALL
        SELECT 'MedicationStatement', med_id, patient_id, source_id, CAST(start_date AS TIMESTAMP),
               CAST(0.9 AS DOUBLE), name, dose || ' ' || schedule FROM medications
        UNION ALL
        SELECT 'Encounter', CAST(encounter_id AS STRING), patient_id, encounter_id % 97, started_at,
               CAST(0.95 AS DOUBLE), enc_class, status FROM encounters""",
    "notes": f"""
        SELECT doc_id, source, lang, n_chars,
               'Patient: ' || {pick('doc_id', ['Smith, John', 'Maria Lopez', 'Li Wei'])} || chr(10) ||
               {pick('doc_id', ['DOB: ', 'Date of Birth: ', 'Born: '])} || lpad(CAST(doc_id % 12 + 1 AS STRING), 2, '0') || '/' ||
               lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0') || '/' || CAST(1940 + doc_id % 60 AS STRING) || chr(10) ||
               'Sex: ' || {pick('doc_id', ['M', 'Female', 'Male'])} || chr(10) ||
               'Age: ' || CAST(20 + doc_id % 70 AS STRING) || chr(10) ||
               'MRN: ' || CAST(1000000 + doc_id AS STRING) || chr(10) ||
               text || chr(10) ||
               'Allergies: ' || {pick('doc_id', ['Penicillin; Latex', 'None', 'Sulfa, Nuts, Dust', 'NKDA'])} || chr(10) ||
               'Medications:' || chr(10) || {pick('doc_id', DRUGS)} || ' 10 mg twice daily' || chr(10) ||
               {pick('doc_id + 3', DRUGS)} || ' 500 mg PO' || chr(10) || chr(10) ||
               'PREOPERATIVE DIAGNOSIS:' || chr(10) || '1. Cholelithiasis' || chr(10) || '2. Obesity' || chr(10) || chr(10) ||
               'Seen 2023-04-1' || CAST(doc_id % 10 AS STRING) || ' and again on March ' || CAST(doc_id % 28 + 1 AS STRING) || ', 2024.' AS text
        FROM documents""",
}

_WORD = re.compile(r"[a-z_]+")


def _needs(sql: str) -> list[str]:
    words = set(_WORD.findall(sql))
    wanted: list[str] = []
    for name in reversed(list(ROLES)):
        if name in words:
            wanted.append(name)
            words |= set(_WORD.findall(ROLES[name]))
    return [name for name in ROLES if name in wanted]


def with_roles(body: str) -> str:
    """Prefix a check query with the role definitions it mentions."""
    ctes = [f"{name} AS ({ROLES[name]})" for name in _needs(body)]
    if not ctes:
        return body
    text = body.strip()
    if text.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + text[15:]
    if text.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + text[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + text


# rows of the largest table in one task of ``Tables.spread``
ROWS_PER_TASK = 250_000


class Tables:
    """Lazy access to base tables and roles of one scale folder."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        ship_package(spark)
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._moved: dict[str, tuple[int, str]] = {}
        self._frames: dict[str, DataFrame] = {}

    @staticmethod
    def run_id() -> str:
        """Fresh name for the folder of one run."""
        return uuid.uuid4().hex[:12]

    def base(self, name: str) -> DataFrame:
        if name in self._frames:
            return self._frames[name]
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return table.repartition(*self._moved[name]) if name in self._moved else table

    def spread(self, **keys: str) -> Tables:
        """The same tables, those named moved by their key into tasks of about ``ROWS_PER_TASK`` rows.

        A shuffle has a fixed number of tasks, or tasks of a fixed size in packed
        bytes, so what its joins and lists hold in memory grows with the tables or
        with how well they pack. Tables that the cores hold at once stay as they are.
        """
        tasks = max(self.base(name).count() for name in keys) // ROWS_PER_TASK + 1
        least = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        if tasks <= min(least, self.spark.sparkContext.defaultParallelism):
            return self
        tables = Tables(self.spark, self.folder)
        # a join of fewer tasks than a shuffle has would be moved again
        tables._moved = {name: (max(tasks, least), key) for name, key in keys.items()}
        return tables

    def over(self, **frames: DataFrame) -> Tables:
        """The same roles over the given frames in place of the base tables they are named after."""
        tables = Tables(self.spark, self.folder)
        tables._moved, tables._frames = self._moved, frames
        return tables

    def __getattr__(self, name: str) -> DataFrame:
        if name in ROLES:
            return self.sql(ROLES[name])
        if name in BASE_TABLES:
            return self.base(name)
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        """Run SQL whose table names are base tables or roles."""
        words = set(_WORD.findall(text))
        frames = {n: getattr(self, n) for n in [*BASE_TABLES, *ROLES] if n in words}
        marked = re.sub(
            r"\b(FROM|JOIN)\s+([a-z_]+)",
            lambda m: f"{m.group(1)} {{{m.group(2)}}}" if m.group(2) in frames else m.group(0),
            text.replace("{", "{{").replace("}", "}}"),  # braces of literals are not placeholders
        )
        used = {n: f for n, f in frames.items() if "{" + n + "}" in marked}
        return self.spark.sql(marked, **used)
