"""Captured pipeline files as one data source: batch reader, stream reader and writer.

A capture is one JSON file per document and stage, named by both. Python lists
the folder and moves file contents; the contents are parsed by Spark with
fixed schemas (``parsed_*``). Many captures are spread over subfolders by their
document: tasks then list them, and don't wait for each other to add a file.
"""

from __future__ import annotations

import datetime
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from chartmill.schemas import EXTRACTION, PAGE_TEXT, PIPELINE_ERROR
from chartmill.session import ship_package

# fixed values: file names of the kinds of captures
PREFIXES = {"page_text": "pdf_text_", "extraction": "llm_output_", "resources": "fhir_data_", "answer": "raw_llm_response_", "error": "error_"}
NAME = re.compile(r"^(?:(pdf_text|llm_output|fhir_data|raw_llm_response)|error_(.+))_(\d+)\.json$")
ROW = "kind string, stage string, document_id bigint, file string, modified timestamp, length bigint, content string"
# files and bytes that one task reads
GROUP_FILES, GROUP_BYTES = 1000, 32 << 20
# subfolders of a spread folder, and those that one task reads
FOLDERS, GROUP_FOLDERS = 256, 8
FOLDER = re.compile(r"^(\d+)-of-(\d+)$")
_EPOCH = datetime.datetime(1970, 1, 1)


@dataclass(frozen=True)
class Capture:
    """A file of the folder, described by its name and its directory entry."""

    kind: str
    stage: str | None
    document_id: int
    path: str
    modified: int
    length: int

    @property
    def position(self) -> tuple[int, str]:
        return self.modified, self.path


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """File system of a folder and the folder's path in it."""
    if re.match(r"file:/(?!/)", path):
        path = path[len("file:"):]
    return fs.FileSystem.from_uri(path)


def captures_in(path: str, kind: str | None = None, document_id: int | None = None) -> list[Capture]:
    """Captures of a folder by age; other files, and files being written, are passed over. Contents are not read."""
    files, folder = open_folder(path)
    kinds = {prefix.rstrip("_"): k for k, prefix in PREFIXES.items()}
    found = []
    for info in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        named = NAME.match(info.base_name)
        if not named or not info.is_file:
            continue
        own = kinds[named[1] or "error"]
        if (kind in (None, own)) and (document_id in (None, int(named[3]))):
            found.append(Capture(own, named[2], int(named[3]), info.path, (info.mtime_ns or 0) // 1000, info.size))
    return sorted(found, key=lambda c: c.position)


def subfolders(path: str, document_id: int | None = None) -> list[str]:
    """Subfolders of a spread folder, by name; of one document, those that may hold it."""
    files, folder = open_folder(path)
    found = []
    for info in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        named = FOLDER.match(info.base_name)
        if named and not info.is_file and (document_id is None or document_id % int(named[2]) == int(named[1])):
            found.append(f"{path.rstrip('/')}/{info.base_name}")
    return sorted(found)


class Group(InputPartition):
    """Files that one task reads, and subfolders that it lists itself."""

    def __init__(self, captures: list[Capture], folders: Sequence[str] = ()):
        self.captures, self.folders = captures, folders


def grouped(captures: list[Capture]) -> list[Group]:
    groups, size = [[]], 0
    for c in captures:
        if groups[-1] and (len(groups[-1]) == GROUP_FILES or size + c.length > GROUP_BYTES):
            groups.append([])
            size = 0
        groups[-1].append(c)
        size += c.length
    return [Group(g) for g in groups]


def rows_of(path: str, captures: list[Capture], with_content: bool) -> Iterator[tuple]:
    files, _ = open_folder(path)
    for c in captures:
        content = None
        if with_content:
            with files.open_input_stream(c.path) as stream:
                content = stream.read().decode("utf-8", "replace")
        yield c.kind, c.stage, c.document_id, c.path.rsplit("/", 1)[-1], _EPOCH + datetime.timedelta(microseconds=c.modified), c.length, content


class CaptureReader(DataSourceReader):
    """One task per group of files; equality with a kind or a document is settled by the file names."""

    def __init__(self, options: dict):
        self.path, self.content = options["path"], options.get("content", "true").lower() == "true"
        self.kind, document = options.get("kind"), options.get("documentid")
        self.document_id = int(document) if document is not None else None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("kind",) and self.kind in (None, f.value):
                self.kind = f.value
            elif isinstance(f, EqualTo) and f.attribute == ("document_id",) and self.document_id in (None, f.value):
                self.document_id = f.value
            else:
                yield f

    def partitions(self):
        flat = captures_in(self.path, self.kind, self.document_id)
        folders = subfolders(self.path, self.document_id)
        spread = [Group([], folders[k:k + GROUP_FOLDERS]) for k in range(0, len(folders), GROUP_FOLDERS)]
        return (grouped(flat) if flat or not spread else []) + spread

    def read(self, partition):
        yield from rows_of(self.path, partition.captures, self.content)
        for folder in partition.folders:
            yield from rows_of(folder, captures_in(folder, self.kind, self.document_id), self.content)


class CaptureStream(DataSourceStreamReader):
    """New captures since the last offset, which is the age and the name of the newest file read.

    A file must not be given a modification time before that of files that
    were read already. A file that is replaced is read again.
    """

    def __init__(self, options: dict):
        self.path, self.kind = options["path"], options.get("kind")

    def initialOffset(self):
        return {"modified": -1, "path": ""}

    def _found(self) -> list[Capture]:
        return sorted((c for f in [self.path, *subfolders(self.path)] for c in captures_in(f, self.kind)), key=lambda c: c.position)

    def latestOffset(self):
        found = self._found()
        return {"modified": found[-1].modified, "path": found[-1].path} if found else self.initialOffset()

    def partitions(self, start, end):
        after, until = (start["modified"], start["path"]), (end["modified"], end["path"])
        return grouped([c for c in self._found() if after < c.position <= until])

    def read(self, partition):
        yield from rows_of(self.path, partition.captures, True)


class CaptureWriter(DataSourceWriter):
    """Writes ``(kind, stage, document_id, content)`` as files, each under a name of its own until it is whole.

    A repeated task replaces its files with equal ones. With ``folders`` the
    files are spread over so many subfolders.
    """

    def __init__(self, options: dict):
        self.path, self.folders = options["path"], int(options.get("folders", "0"))

    def write(self, iterator):
        files, root = open_folder(self.path)
        files.create_dir(root)
        made = {root}
        for row in iterator:
            folder = f"{root}/{row.document_id % self.folders:03d}-of-{self.folders}" if self.folders else root
            if folder not in made:
                files.create_dir(folder)
                made.add(folder)
            stage = f"{row.stage}_" if row.kind == "error" else ""
            name = f"{folder}/{PREFIXES[row.kind]}{stage}{row.document_id}.json"
            part = f"{folder}/.{uuid.uuid4().hex}"
            with files.open_output_stream(part) as stream:
                stream.write(row.content.encode())
            files.move(part, name)
        return WriterCommitMessage()


class CaptureSource(DataSource):
    """``spark.read.format("captures")``: options ``path``, ``kind``, ``documentId``, ``content`` (false: list only), ``folders`` (of a writer)."""

    @classmethod
    def name(cls):
        return "captures"

    def schema(self):
        return ROW

    def reader(self, schema):
        return CaptureReader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema):
        return CaptureStream({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite):
        return CaptureWriter({k.lower(): v for k, v in self.options.items()})


def register_captures(spark: SparkSession) -> None:
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CaptureSource)


def read_captures(spark: SparkSession, path: str, kind: str | None = None, document_id: int | None = None, content: bool = True) -> DataFrame:
    register_captures(spark)
    reader = spark.read.format("captures").option("path", path).option("content", str(content).lower())
    for name, value in (("kind", kind), ("documentId", document_id)):
        reader = reader if value is None else reader.option(name, str(value))
    return reader.load()


def write_captures(rows: DataFrame, path: str, spread: bool = False) -> None:
    """Write ``(kind, stage, document_id, content)``; files of the same name are replaced.

    ``spread`` writes from all tasks of a shuffle into subfolders, each from one task; a folder keeps one of both forms.
    """
    spark = rows.sparkSession
    register_captures(spark)
    rows = rows.select("kind", "stage", "document_id", "content")
    if spread:
        tasks = min(FOLDERS, int(spark.conf.get("spark.sql.shuffle.partitions")))
        folder = F.pmod("document_id", F.lit(FOLDERS))
        rows = rows.repartitionById(tasks, (folder % tasks).cast("int")).sortWithinPartitions(folder)
    rows.write.format("captures").option("path", path).option("folders", str(FOLDERS if spread else 0)).mode("append").save()


def listed(captures: DataFrame) -> DataFrame:
    """Captures newest first, without their content."""
    return captures.select("file", "kind", "document_id", "modified", "length").orderBy(F.desc("modified"), "file")


def _parsed(captures: DataFrame, schema: StructType) -> DataFrame:
    """The content by a fixed schema; what does not parse is kept whole in ``_corrupt_record``."""
    fields = [f for f in schema if f.name != "_corrupt_record"]
    with_bad = StructType([*fields]).add("_corrupt_record", "string")
    body = F.from_json("content", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return captures.select("file", "document_id", body.alias("body")).select("file", F.coalesce("body.document_id", "document_id").alias("document_id"), *[f"body.{f.name}" for f in with_bad if f.name != "document_id"])


def parsed_extractions(captures: DataFrame) -> DataFrame:
    return _parsed(captures, EXTRACTION)


def parsed_page_texts(captures: DataFrame) -> DataFrame:
    return _parsed(captures, PAGE_TEXT)


def parsed_errors(captures: DataFrame) -> DataFrame:
    return _parsed(captures, PIPELINE_ERROR)


def parsed_resources(captures: DataFrame) -> DataFrame:
    """One row per resource, its open body as variant; a file that does not parse gives one row with its text in ``_corrupt_record``."""
    doc = captures.select("file", "document_id", "content", F.try_parse_json("content").alias("doc"))
    bodies = F.try_variant_get("doc", "$.fhir_resources", "array<variant>")
    rows = doc.select("file", "document_id", F.try_variant_get("doc", "$.patient_id", "string").alias("patient_id"),
                      F.when(F.col("doc").isNull(), F.col("content")).alias("_corrupt_record"), F.posexplode_outer(bodies).alias("ord", "body"))
    rows = rows.filter("body IS NOT NULL OR _corrupt_record IS NOT NULL")
    return rows.withColumns({"resource_type": F.try_variant_get("body", "$.resourceType", "string"), "resource_id": F.try_variant_get("body", "$.id", "string")})
