"""WARC archives with a two-level capture index."""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartmill.llm.common import new_folder, slices, with_python, write_table

# bytes after which a task starts another archive, lines of an index block, captures of an index part
ARCHIVE_BYTES = 256 << 20
BLOCK_LINES = 2000
PART_LINES = 2_000_000
# fixed values of the format; the date is a parameter of the writer
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = "url_key string, page_id bigint, file string, offset bigint, length bigint"
RECORDS = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload string"


def url_key(url: Column) -> Column:
    """Reversed-host key: ``com,example)/path``; no scheme, user, port or leading www, all in lower case. Null is empty."""
    low = F.lower(F.coalesce(url, F.lit("")))
    rest = F.regexp_replace(F.regexp_replace(low, r"^(?:[a-z][a-z0-9+.\-]*:)?//", ""), r"^[^/?#@]*@", "")
    host = F.regexp_replace(F.regexp_extract(rest, r"^([^/:?#]*)", 1), r"^www\d*\.", "")
    path = F.regexp_replace(rest, r"^[^/:?#]*(?::\d*)?", "")
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(path == "", "/").otherwise(path))
    return F.regexp_replace(key, r"[\x00-\x20\x7F]", "+")


def _spot(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def _record(page_id: int | None, url: str | None, html: str, sha1: str, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member of its own. A revisit has the head of the response and no payload."""
    payload = html.encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode())
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + packer.flush()


def parse_record(member: bytes) -> dict:
    """Fields of a record, its digest computed from the payload; a revisit has no payload and the digest of its head."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    page, refers = fields["WARC-Record-ID"][10:-1], fields.get("WARC-Refers-To", "<urn:page:>")[10:-1]
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    out = {"page_id": int(page) if page else None, "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "payload_bytes": size, "payload_digest": stated,
           "refers_to": int(refers) if refers else None, "payload": None}
    if out["record_type"] == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if found != stated or len(payload) != size:
            raise ValueError(f"record of page {page}: the payload is not what its head states")
        out |= {"payload": payload.decode(), "payload_digest": found}
    return out


@dataclass(frozen=True)
class Archive:
    """Archives in ``folder``, their captures, and the index: parts of compressed blocks, a directory of blocks, the first keys of the parts."""

    folder: str
    captures: DataFrame
    directory: DataFrame
    parts: list[tuple[str, int, str]]


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of ``pages(page_id, url, html)``; returns the captures.

    Of rows with equal payloads of at least ``least_bytes`` bytes the one with
    the smallest id is a response, the others are revisits of it. Equal means
    the same SHA-1 and length. Smallest ids are combined before the shuffle,
    and the join back to the pages can be split, so a payload that very many
    pages share is no hot spot.

    A task writes files under names of its own, so a repeated task never
    touches files of another attempt; captures name only finished ones. Null
    html is an empty payload, a null url has an empty key. A row without id is
    never referred to: it revisits a row with an id, else it is a response.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("sha1"), F.octet_length(html).alias("size"))
    first = rows.filter(F.col("size") >= least_bytes).groupBy("sha1", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("times")).filter("times > 1").drop("times")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")
    marked = rows.join(first, ["sha1", "size"], "left").select("page_id", "url", "html", "sha1", refers, url_key(F.col("url")).alias("url_key"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _spot(folder)
        store.create_dir(path, recursive=True)
        out, name, at = None, "", 0
        for batch in slices(batches, "html", 8 << 20):
            found = []
            for page_id, url, html, sha1, refers_to, key in zip(*(batch.column(c).to_pylist() for c in range(6))):
                if out is None or at > ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                member = _record(page_id, url, html, sha1, refers_to, date)
                out.write(member)
                found.append((key, page_id, name, at, len(member)))
                at += len(member)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["url_key", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    return write_table(with_python(marked).mapInArrow(write, CAPTURES), "captures")


def _line(key: str, page_id: int | None, *rest) -> str:
    """Sorts as its key, then as its id; rows without id first."""
    place = "-" if page_id is None else f"{page_id + (1 << 63):020d}"
    return " ".join([key, place, *map(str, rest)])


def build_index(captures: DataFrame, folder: str, part_lines: int = PART_LINES, block_lines: int = BLOCK_LINES) -> tuple[DataFrame, list[tuple[str, int, str]]]:
    """Sort captures into parts of compressed blocks; returns the block directory and the parts.

    The key is the url key with the id behind it, so captures of one url may
    span blocks and parts. The directory has one row per block. Only the first
    line of each part comes to the driver: one per ``part_lines`` captures.
    """
    count = max(1, -(-captures.count() // part_lines))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _spot(folder)
        store.create_dir(path, recursive=True)
        lines: list[str] = []
        part, at, out = uuid.uuid4().hex, 0, None

        def flush(block: list[str]) -> pa.RecordBatch:
            nonlocal at, out
            if out is None:
                out = store.open_output_stream(f"{path}/{part}.cdxz", compression=None)
            packed = zlib.compress("\n".join(block).encode(), 6)
            out.write(packed)
            row = pa.RecordBatch.from_arrays([pa.array([part]), pa.array([block[0]]), pa.array([at], pa.int64()), pa.array([len(packed)], pa.int64())], ["part", "first_line", "offset", "length"])
            at += len(packed)
            return row

        for batch in batches:
            lines += [_line(*row) for row in zip(*(batch.column(c).to_pylist() for c in range(5)))]
            while len(lines) >= block_lines:
                yield flush(lines[:block_lines])
                del lines[:block_lines]
        if lines:
            yield flush(lines)
        if out is not None:
            out.close()

    ordered = captures.repartitionByRange(count, "url_key", "page_id").sortWithinPartitions("url_key", "page_id", "file", "offset")
    directory = write_table(with_python(ordered).mapInArrow(pack, "part string, first_line string, offset bigint, length bigint"), "block-directory")
    firsts = directory.groupBy("part").agg(F.min("first_line").alias("first_line"), F.count("*").alias("blocks")).collect()
    return directory, sorted((r.first_line, r.blocks, r.part) for r in firsts)


def archive(pages: DataFrame, least_bytes: int = 0, part_lines: int = PART_LINES, block_lines: int = BLOCK_LINES) -> Archive:
    """Write and index the archives of ``pages`` in a folder of their own."""
    folder = new_folder(pages.sparkSession, "archive")
    captures = write_archives(pages, f"{folder}/warc", least_bytes)
    directory, parts = build_index(captures, f"{folder}/index", part_lines, block_lines)
    return Archive(folder, captures, directory, parts)


def look_up(store: Archive, wanted: DataFrame) -> DataFrame:
    """Captures of ``wanted(url_key, page_id)``, each once: ``file, offset, length``.

    A key finds its part by bisection in the first keys, its block by bisection
    in that part's directory, and its lines by bisection in the block. Only
    blocks that hold a wanted key are read, each by one range read, as a task
    sees its keys in order.
    """
    firsts, names, folder = [p[0] for p in store.parts], [p[2] for p in store.parts], f"{store.folder}/index"
    if not names:
        return store.captures.select("file", "offset", "length")
    spark = wanted.sparkSession

    def find_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [_line(k, p) for k, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            # a key's captures begin in the part before the first line above it, and may go on in those behind
            rows = [(names[i], line) for line in lines for i in range(max(0, bisect.bisect_left(firsts, line) - 1), max(1, bisect.bisect_right(firsts, line + "!")))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["part", "line"])

    placed = with_python(wanted.select("url_key", "page_id").distinct()).mapInArrow(find_part, "part string, line string")
    # the directory rows of a part stand before its lines; lines of one part may be dealt to several tasks
    spread = max(1, spark.sparkContext.defaultParallelism // len(names))
    keyed = placed.withColumn("piece", F.pmod(F.xxhash64("line"), F.lit(spread)).cast("int")).withColumn("place", F.lit(1)).withColumn("offset", F.lit(0).cast("bigint")).withColumn("length", F.lit(0).cast("bigint"))
    shelf = store.directory.select("part", F.col("first_line").alias("line"), F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("piece"), F.lit(0).alias("place"), "offset", "length")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _spot(folder)
        key, starts, blocks, opened, number, lines = None, [], [], None, -1, []
        for batch in batches:
            found = []
            for part, piece, place, line, offset, length in zip(*(batch.column(c).to_pylist() for c in range(6))):
                if (part, piece) != key:
                    if opened is not None:
                        opened.close()
                    key, starts, blocks, number = (part, piece), [], [], -1
                    opened = files.open_input_file(f"{root}/{part}.cdxz")
                if place == 0:
                    starts.append(line)
                    blocks.append((offset, length))
                    continue
                at = max(0, bisect.bisect_left(starts, line) - 1)
                while at < len(starts) and (starts[at] <= line + "!" or at == 0):
                    if at != number:
                        opened.seek(blocks[at][0])
                        lines, number = zlib.decompress(opened.read(blocks[at][1])).decode().split("\n"), at
                    here = bisect.bisect_left(lines, line + " ")
                    while here < len(lines) and lines[here].startswith(line + " "):
                        file, start, size = lines[here].rsplit(" ", 3)[1:]
                        found.append((file, int(start), int(size)))
                        here += 1
                    at += 1
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.int64(), pa.int64()))], ["file", "offset", "length"])
        if opened is not None:
            opened.close()

    columns = ["part", "piece", "place", "line", "offset", "length"]
    ready = shelf.select(*columns).unionByName(keyed.select(*columns)).repartition("part", "piece").sortWithinPartitions("part", "piece", "place", "line")
    return ready.mapInArrow(find, "file string, offset bigint, length bigint")


def read_records(store: Archive, captures: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of ``captures(file, offset, length)`` by range reads, in file order within a task."""
    folder = f"{store.folder}/warc"
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _spot(folder)
        name, opened = None, None
        for batch in batches:
            rows = batch.to_pydict()
            for start in range(0, batch.num_rows, 128):
                found = []
                for file, offset, length in zip(*(rows[c][start:start + 128] for c in ("file", "offset", "length"))):
                    if file != name:
                        if opened is not None:
                            opened.close()
                        name, opened = file, files.open_input_file(f"{root}/{file}")
                    opened.seek(offset)
                    record = parse_record(opened.read(length))
                    if not with_payload:
                        record["payload"] = None
                    found.append(record)
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], k) for n, k in zip(names, kinds)], names)
        if opened is not None:
            opened.close()

    tasks = max(1, captures.sparkSession.sparkContext.defaultParallelism)
    ordered = captures.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return with_python(ordered).mapInArrow(read, RECORDS)
