"""Best-fit packing of tokenised documents in bulk-synchronous rounds."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartmill.llm.common import slices, text_of, tokenizer_path, with_python, write_table

CAPACITY = 2048
# id that ends each document
END = 0
# rows of a range of sizes that a task sweeps
RANGE_ROWS = 100_000
# fixed value: the pattern that cuts a text before the merges of the byte-level vocabulary
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECES = "key bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


# ---------------------------------------------------------------- tokens
@lru_cache(maxsize=1)
def _tokenizers(path: str):
    """The vocabulary in both libraries that read it, kept from task to task."""
    import tiktoken
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    slow = Tokenizer.from_file(path)
    special = {t.content for t in slow.get_added_tokens_decoder().values()}
    letters = _byte_letters()
    ranks = {bytes(letters[c] for c in word): i for word, i in slow.get_vocab().items() if word not in special}
    return slow, tiktoken.Encoding("byte-pairs", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={}), special


def _byte_letters() -> dict[str, int]:
    """Byte that each letter of a byte-level vocabulary stands for: printable ones themselves, the rest from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(others)}


def token_ids(text: str, path: str) -> np.ndarray:
    """Ids of a text as the tokenizers library gives them, without added special tokens.

    Latin texts go through the faster library with the same vocabulary. Other
    texts, and those that spell a special token, whose string is one token, do
    not: there the two may differ.
    """
    slow, fast, special = _tokenizers(path)
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        latin = False
    else:
        latin = not any(s in text for s in special)
    return fast.encode_to_numpy(text, disallowed_special=()) if latin else np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def cut_pieces(length: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document; only the first may be shorter than the capacity."""
    whole = (length - 1) // capacity
    first = length - whole * capacity
    return [(0, first), *[(first + k * capacity, capacity) for k in range(whole)]]


def tokenized_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer_folder: str | None = None) -> DataFrame:
    """Pieces of every document with the checksum of their ids, and a key of their own.

    Ids are those of the tokenizers library for ``byte_bpe_50k.json`` without
    added special tokens, then the id 0.
    """
    path = tokenizer_path("byte_bpe_50k.json", tokenizer_folder)

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the same in every attempt of a task, and different in all tasks
        key = TaskContext.get().partitionId() << 36
        for batch in slices(batches, "text", 4 << 20):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(token_ids(text.as_py(), path), END).astype("<u4")
                for number, (start, length) in enumerate(cut_pieces(len(ids), capacity)):
                    rows.append((key, doc_id, number, start, length, zlib.crc32(ids[start:start + length])))
                    key += 1
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["key", "doc_id", "piece", "start", "length", "ids_crc32"])

    source = with_python(docs).select("doc_id", text_of().alias("text"))
    return source.mapInArrow(tokenize, PIECES)


# ---------------------------------------------------------------- one round
def sweep(size: np.ndarray, is_doc: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Match documents to slots within one range of sizes.

    Rows are swept from the largest size down, slots before documents of the
    same size. A document takes the slot met last that is still free: its
    successor, the smallest that holds it. Returns indices of matched
    documents, of their slots, of documents left over in this order, and of
    slots left over, smallest first.
    """
    order = np.lexsort((name, is_doc, -size))
    doc = is_doc[order]
    depth = np.cumsum(np.where(doc, -1, 1))
    # a document that finds no slot in this range sets a new minimum
    floor = np.minimum.accumulate(np.minimum(depth, 0))
    lone = doc & (depth < np.append(0, floor[:-1]))
    rest = order[~lone]
    doc = doc[~lone]
    depth = np.cumsum(np.where(doc, -1, 1))
    level = np.where(doc, depth + 1, depth)
    # on one level slots and documents alternate
    stack = np.argsort(level, kind="stable")
    slot = stack[~doc[stack]]
    taken = np.zeros(len(rest), dtype=bool)
    following = np.append(stack[1:], -1)[~doc[stack]]
    hit = np.array([f >= 0 and doc[f] and level[f] == level[s] for s, f in zip(slot, following)], dtype=bool) if len(slot) else np.zeros(0, dtype=bool)
    taken[slot[hit]] = taken[following[hit]] = True
    free = rest[~taken & ~doc]
    return rest[following[hit]], rest[slot[hit]], order[lone], free[::-1]


def across(left: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Give documents left over in a range to slots left over in ranges of larger sizes.

    ``left`` has range, documents and slots, from the largest sizes down. Only
    these counts are looked at. Returns ``(document range, from rank, slot
    range, from rank, count)``.
    """
    stack, out = [], []
    for part, docs, slots in left:
        given = 0
        while given < docs and stack:
            where, rank, free = stack.pop()
            n = min(free, docs - given)
            out.append((part, given, where, rank, n))
            given += n
            if n < free:
                stack.append((where, rank + n, free - n))
        if slots:
            stack.append((part, 0, slots))
    return out


def ranges(counts: dict[tuple[int, bool], int], rows: int) -> list[tuple[int, bool, int, int]]:
    """Cut the sizes, from the largest down, into ranges of about ``rows`` rows.

    ``counts`` has the rows of each size and kind. A size with more rows than a
    range gets several ranges of its own, over which its rows are dealt by
    hash: in what order equal sizes are swept does not matter. Returns
    ``(size, is document, first range, ranges)``.
    """
    out, at, filled = [], 0, 0
    for (size, doc), n in sorted(counts.items(), key=lambda c: (-c[0][0], c[0][1])):
        if filled and filled + n > rows:
            at, filled = at + 1, 0
        parts = -(-n // rows)
        out.append((size, doc, at, parts))
        if parts > 1:
            at, filled = at + parts, 0
        else:
            filled += n
    return out


# ---------------------------------------------------------------- rounds
def best_fit(documents: DataFrame, capacity: int = CAPACITY, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Sequence and place of ``documents(key, length)``: ``key, sequence, round, slot``.

    As many sequences are opened as the total length needs at least. A round
    sorts documents and gaps into ranges of sizes, sweeps every range for
    best fits, matches what is left over between ranges by rank, and takes the
    lengths from the gaps. A gap that is twice the longest document or more
    offers several slots. When few documents found a gap, further sequences are
    opened for what is left. Sizes are whole numbers up to ``capacity``, so the
    counts per size that the driver reads are bounded.
    """
    spark = documents.sparkSession
    todo = documents.select("key", "length")
    gaps, placed, opened, turn, before = None, [], 0, 0, None
    while True:
        totals = todo.groupBy("length").agg(F.count("*").alias("n")).collect()
        left = sum(r.n for r in totals)
        if not left:
            break
        longest, shortest = max(r.length for r in totals), min(r.length for r in totals)
        if before is None or left > 0.7 * before:
            more = -(-sum(r.n * r.length for r in totals) // capacity)
            fresh = spark.range(opened, opened + more).select(F.col("id").alias("bin"), F.lit(capacity).cast("bigint").alias("gap"))
            gaps, opened = fresh if gaps is None else gaps.unionByName(fresh), opened + more
        before = left
        gaps = write_table(gaps.filter(F.col("gap") >= shortest), "packing-gaps")
        most = 1 + -(-2 * left // max(1, gaps.count()))
        # slots of the longest document's length where two or more fit, else the gap itself
        times = F.least(F.greatest(F.floor(F.col("gap") / longest), F.lit(1)), F.lit(most)).cast("int")
        slots = gaps.select("bin", "gap", F.explode(F.sequence(F.lit(1), times)).alias("slot"), times.alias("times"))
        slots = slots.select(F.col("bin").alias("name"), "slot", F.when(F.col("times") > 1, F.lit(longest).cast("bigint")).otherwise(F.col("gap")).alias("size"))
        rows = todo.select(F.col("key").alias("name"), F.lit(0).alias("slot"), F.col("length").alias("size"), F.lit(True).alias("doc")).unionByName(slots.withColumn("doc", F.lit(False)))
        counts = {(r.length, True): r.n for r in totals} | {(r.size, False): r.n for r in slots.groupBy("size").agg(F.count("*").alias("n")).collect()}
        cut = spark.createDataFrame(ranges(counts, range_rows), "size bigint, doc boolean, at int, parts int")
        # two rows a size at most
        dealt = rows.join(F.broadcast(cut), ["size", "doc"]).withColumn("part", F.col("at") + F.pmod(F.xxhash64("name", "slot"), F.col("parts")).cast("int"))

        def match(group: pd.DataFrame) -> pd.DataFrame:
            name, slot, size, doc = (group[c].to_numpy() for c in ("name", "slot", "size", "doc"))
            docs, bins, lone, free = sweep(size, doc, name)
            part = int(group.part.iloc[0])
            return pd.concat([
                pd.DataFrame({"part": part, "rank": -1, "key": name[docs], "length": size[docs], "bin": name[bins], "slot": slot[bins]}),
                pd.DataFrame({"part": part, "rank": np.arange(len(lone)), "key": name[lone], "length": size[lone], "bin": -1, "slot": 0}),
                pd.DataFrame({"part": part, "rank": np.arange(len(free)), "key": -1, "length": 0, "bin": name[free], "slot": slot[free]}),
            ])

        schema = "part int, rank bigint, key bigint, length bigint, bin bigint, slot int"
        swept = write_table(with_python(dealt).groupBy("part").applyInPandas(match, schema), "packing-sweep")
        lone = swept.filter("rank >= 0 AND key >= 0")
        free = swept.filter("rank >= 0 AND key < 0")
        rest = swept.filter("rank >= 0").groupBy("part").agg(F.count_if(F.col("key") >= 0).alias("docs"), F.count_if(F.col("key") < 0).alias("slots")).orderBy("part").collect()
        given = spark.createDataFrame(across([(r.part, r.docs, r.slots) for r in rest]), "part int, rank_from bigint, slot_part int, slot_from bigint, n bigint")
        sent = lone.join(given, (lone.part == given.part) & lone["rank"].between(given.rank_from, given.rank_from + given.n - 1)).select(
            "key", "length", F.col("slot_part").alias("part"), (lone["rank"] - F.col("rank_from") + F.col("slot_from")).alias("rank"))
        got = sent.join(free.select("part", "rank", "bin", "slot"), ["part", "rank"]).select("key", "length", "bin", "slot")
        matched = write_table(swept.filter("rank < 0").select("key", "length", "bin", "slot").unionByName(got).withColumn("round", F.lit(turn)), "packing-placed")
        placed.append(matched)
        todo = write_table(lone.select("key", "length").join(matched.select("key"), "key", "left_anti"), "packing-todo")
        used = matched.groupBy("bin").agg(F.sum("length").alias("used"))
        gaps = gaps.join(used, "bin", "left").select("bin", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap"))
        turn += 1
    if not placed:
        return spark.createDataFrame([], "key bigint, sequence bigint, round int, slot int")
    return reduce(DataFrame.unionByName, placed).select("key", F.col("bin").alias("sequence"), "round", "slot")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, range_rows: int = RANGE_ROWS, tokenizer_folder: str | None = None) -> DataFrame:
    """Pack whole documents into few sequences of at most ``capacity`` tokens.

    Returns per piece ``doc_id, piece, start, length, ids_crc32, sequence_id,
    offset``. Only a document longer than a sequence is cut; its full pieces
    are sequences of their own. The others are placed by ``best_fit``. Offsets
    follow the order in which a sequence was filled, without gaps.

    Texts are read once, for their tokens; what is sorted and shuffled after
    that is a few numbers a piece. A null or empty text is the end token alone.
    Null ids and repeated rows are packed as documents of their own. Extra
    columns are not read.
    """
    pieces = write_table(tokenized_pieces(docs, capacity, tokenizer_folder), "packing-pieces")
    whole = pieces.filter(F.col("length") == capacity)
    part = pieces.filter(F.col("length") < capacity)
    spots = part.join(best_fit(part, capacity, range_rows), "key")
    # a sequence holds as many pieces as tokens at most
    order = Window.partitionBy("sequence").orderBy("round", "slot", "key").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(order), F.lit(0)).alias("offset")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    # sequences of full pieces have numbers below zero
    alone = whole.select(*columns, (-1 - F.col("key")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return alone.unionByName(spots.select(*columns, F.col("sequence").alias("sequence_id"), offset))
