"""Exact deduplication by content hash with byte comparison."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartmill.llm.common import text_of, write_table

# fixed value: the characters that do not count, space and tab to carriage return
BLANK = r"[\x20\x09-\x0D]+"


def normalized(text: Column) -> Column:
    """The text without its ASCII blanks."""
    return F.regexp_replace(text, BLANK, "")


def exact_groups(docs: DataFrame, content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    """Groups of equal texts: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are grouped by a 128-bit hash of their normalised bytes; in a group
    the row with the most code points stays, then the smallest id. The bytes of
    each row are compared with those of the row that stays. Rows that differ
    from it only share the hash: they form the next round's groups, so a hash
    with collisions costs rounds, never wrong groups.

    Only ids, hashes and lengths are shuffled for all rows; texts move only for
    hashes that more than one row has. Groups are combined before the shuffle,
    and the join that brings the kept text to its group can be split, so one
    huge group of copies does not meet in one task.

    Null texts count as empty and equal one another. A null id sorts after all
    other ids and is kept only if no row of its group has an id. Repeated rows
    (same id, same text) count in ``group_size`` and are kept together, as they
    are one document. Extra columns are ignored.
    """
    body = normalized(F.col("text"))
    source = docs.select("doc_id", text_of().alias("text")).select(
        "doc_id", F.length("text").alias("n"), content_hash(body).alias("h"), F.sha2(body, 256).alias("sha"), body.alias("body")
    )
    done = []
    while True:
        hashed = write_table(source.drop("body"), "exact-dedup-hashes")
        best = F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "sha"))
        groups = hashed.groupBy("h").agg(F.count("*").alias("size"), best.alias("best")).select("h", "size", F.col("best.doc_id").alias("keep_id"), F.col("best.sha").alias("sha"))
        done.append(groups.filter("size = 1").select("keep_id", "sha", F.col("keep_id").alias("doc_id"), F.lit(1).cast("bigint").alias("size")))
        shared = groups.filter("size > 1")
        stays = source.h.eqNullSafe(shared.h) & source.doc_id.eqNullSafe(shared.keep_id) & source.sha.eqNullSafe(shared.sha)
        # a table of its own: the join with it then starts from plain exchanges, which can be split
        kept = write_table(source.join(shared, stays).select(source.h, "keep_id", F.col("body").alias("kept_body")).dropDuplicates(["h"]), "exact-dedup-kept")
        same = F.col("body") == F.col("kept_body")
        compared = write_table(
            source.join(kept, "h").select("h", "doc_id", "n", "sha", "keep_id", same.alias("same"), F.when(~same, F.col("body")).alias("body")), "exact-dedup"
        )
        equal = compared.filter("same")
        sizes = equal.groupBy("h").agg(F.count("*").alias("size"))
        done.append(equal.join(sizes, "h").select("keep_id", "sha", "doc_id", "size"))
        rest = compared.filter("NOT same")
        if rest.isEmpty():
            break
        source = rest.select("doc_id", "n", "h", "sha", "body")
    out = reduce(DataFrame.unionByName, done)
    return out.select("doc_id", "keep_id", F.col("size").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, without the copies that ``exact_groups`` drops.

    Of repeated rows (same id, same text) one stays, whatever their other
    columns. Null and empty texts are copies of one another. Columns may have
    any names: a row travels as one value. No rows give no rows.
    """
    groups = exact_groups(docs)
    marks = write_table(
        groups.groupBy(F.col("doc_id").alias("marked_id"), F.col("text_sha256").alias("marked_sha")).agg(F.bool_or("kept").alias("kept"), F.count("*").alias("times")).filter("NOT kept OR times > 1"), "exact-dedup-marks"
    )
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.sha2(normalized(text_of()), 256).alias("sha"))
    same = F.col("id").eqNullSafe(F.col("marked_id")) & (F.col("sha") == F.col("marked_sha"))
    marked = rows.join(marks.hint("merge"), same, "left").filter("kept IS NULL OR kept")
    if marks.filter("kept").isEmpty():
        return marked.select("row.*")
    once = marked.filter("times IS NULL")
    return once.unionByName(marked.filter("times IS NOT NULL").dropDuplicates(["id", "sha"])).select("row.*")
