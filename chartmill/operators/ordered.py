"""Ordered computations that stay exact and balanced when one key is huge.

A window over one key runs in one task. The helpers below cut each key into
buckets along its order, work per (key, bucket), and carry one small row per
bucket across, so a key that holds a third of all rows is still spread out.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of each key. The rank filter becomes a group limit that
    already runs before the shuffle, so each task forwards at most k rows a key."""
    w = W.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
    return out.drop(rank) if k == 1 else out


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Rows cut along keys and order into slices of about one size, numbered in ``__bucket``.

    The slices are the range partitions of the rows themselves, so a key with
    many rows spans many of them, whatever its values are. They are written to
    the shared folder: their numbers must not change when a task is repeated.
    """
    from chartmill.session import cut_lineage

    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(count, *keys, *order).withColumn("__bucket", F.spark_partition_id()))


def _beside(df: DataFrame, carry: DataFrame, cut: Sequence[str]) -> DataFrame:
    """``df`` with the row of its key and slice in ``carry``; a null key is a key like any other."""
    renamed = carry.withColumnsRenamed({c: f"__key{i}" for i, c in enumerate(cut)})
    same = reduce(Column.__and__, [df[c].eqNullSafe(renamed[f"__key{i}"]) for i, c in enumerate(cut)])
    return df.join(renamed, same, "left").drop(*[f"__key{i}" for i in range(len(cut))])


def previous_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Add ``prev_<column>`` from the preceding row of the key; ``order`` must be free of ties."""
    keys, cut = list(keys), [*keys, "__bucket"]
    df = sliced(df, keys, order)
    kept = F.struct(*columns)
    inside = F.lag(kept).over(W.partitionBy(*cut).orderBy(*order))
    lasts = df.groupBy(*cut).agg(F.max_by(kept, F.struct(*order)).alias("__last"))
    carry = lasts.withColumn("__carry", F.lag("__last").over(W.partitionBy(*keys).orderBy("__bucket"))).drop("__last")
    out = _beside(df.withColumn("__prev", inside), carry, cut)
    best = F.coalesce(F.col("__prev"), F.col("__carry"))
    return out.withColumns({f"prev_{c}": best[c] for c in columns}).drop("__bucket", "__prev", "__carry")


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: str, name: str = "running") -> DataFrame:
    """Running sum of ``value`` along ``order`` within each key."""
    keys, cut = list(keys), [*keys, "__bucket"]
    df = sliced(df, keys, order)
    sums = df.groupBy(*cut).agg(F.sum(value).alias("__sum"))
    before = W.partitionBy(*keys).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    carry = sums.withColumn("__carry", F.sum("__sum").over(before)).drop("__sum")
    inside = F.sum(value).over(W.partitionBy(*cut).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    out = _beside(df.withColumn("__inside", inside), carry, cut)
    return out.withColumn(name, F.col("__inside") + F.coalesce(F.col("__carry"), F.lit(0))).drop("__bucket", "__inside", "__carry")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "place") -> DataFrame:
    """Position of each row of the key from 1, for all rows."""
    return running_total(df.withColumn("__one", F.lit(1)), keys, order, "__one", name).drop("__one")


def within_distance(df: DataFrame, keys: Sequence[str], axis: str, radius: int, value: Column, kind: str, name: str) -> DataFrame:
    """Minimum, maximum or sum of ``value`` over all rows of the key with ``|axis - own axis| <= radius``.

    No row pairs are formed. Rows first collapse to one per (key, axis); each
    block of ``radius`` axis units then holds at most ``radius`` of them. The
    interval of a row covers its own block whole, a tail of the block before
    and a head of the block after, which are running aggregates read at probes.
    """
    fold = {"min": F.min, "max": F.max, "sum": F.sum}[kind]
    keys = list(keys)
    points = df.groupBy(*keys, axis).agg(fold(value).alias("__v"))
    here = F.col(axis)

    def block(position: Column) -> Column:
        return F.floor(position / F.lit(radius)).cast("bigint")

    rows = F.array(
        F.struct(block(here).alias("blk"), here.alias("pos"), F.lit(0).alias("probe"), F.col("__v").alias("v")),
        F.struct((block(here) - 1).alias("blk"), (here - radius).alias("pos"), F.lit(1).alias("probe"), F.lit(None).cast(points.schema["__v"].dataType).alias("v")),
        F.struct((block(here) + 1).alias("blk"), (here + radius).alias("pos"), F.lit(2).alias("probe"), F.lit(None).cast(points.schema["__v"].dataType).alias("v")),
    )
    spread = points.select(*keys, here.alias("__home"), F.inline(rows))
    cut = W.partitionBy(*keys, "blk")
    so_far = cut.orderBy(F.col("pos"), F.col("probe")).rowsBetween(W.unboundedPreceding, 0)
    to_come = cut.orderBy(F.col("pos").desc(), F.col("probe")).rowsBetween(W.unboundedPreceding, 0)
    picked = (
        F.when(F.col("probe") == 0, fold("v").over(cut))
        .when(F.col("probe") == 1, fold("v").over(to_come))
        .otherwise(fold("v").over(so_far))
    )
    near = (
        spread.withColumn("__near", picked)
        .groupBy(*keys, F.col("__home").alias(axis))
        .agg(fold("__near").alias(name))
    )
    return df.join(near, [*keys, axis], "left")


def last_seen(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, bucket: Column, name: str) -> DataFrame:
    """Newest non-null ``value`` at or before each row along ``order``.

    With a negated order and bucket it looks ahead instead. Used as an as-of
    join: union the probe rows (null value) with the rows that carry a value.
    """
    keys, cut = list(keys), [*keys, "__bucket"]
    df = df.withColumns({"__bucket": bucket, "__value": value})
    inside = F.last("__value", ignorenulls=True).over(W.partitionBy(*cut).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    sorted_struct = F.struct(*[F.col(f"__o{i}") for i in range(len(order))])
    marked = df.withColumns({f"__o{i}": c for i, c in enumerate(order)})
    lasts = marked.groupBy(*cut).agg(F.max_by(F.col("__value"), F.when(F.col("__value").isNotNull(), sorted_struct)).alias("__last"))
    before = W.partitionBy(*keys).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    carry = lasts.withColumn("__carry", F.last("__last", ignorenulls=True).over(before)).drop("__last")
    out = _beside(df.withColumn("__inside", inside), carry, cut)
    return out.withColumn(name, F.coalesce("__inside", "__carry")).drop("__bucket", "__value", "__inside", "__carry")


def anchor_groups(df: DataFrame, key: str, at: str, width: int, name: str = "anchor") -> DataFrame:
    """Add the anchor of each row: a group starts at its first row and takes every
    row up to ``width`` later; the next later row starts the next group.

    ``at`` is an integer time. The chain of anchors is followed by pointer
    doubling over distinct times, so no key is ever scanned by a single task.
    """
    from chartmill.session import cut_lineage

    times = df.select(key, F.col(at).alias("__t")).distinct()
    ahead = times.select(key, F.col("__t"), F.col("__t").alias("__from"), F.lit(True).alias("__row"))
    probes = times.select(key, (F.col("__t") + width).alias("__t"), F.col("__t").alias("__from"), F.lit(False).alias("__row"))
    # looking ahead: strictly later rows come first in the negated order
    nxt = last_seen(
        ahead.unionByName(probes), [key], [-F.col("__t"), F.col("__row").cast("int")],
        F.when(F.col("__row"), F.col("__t")), F.floor(-F.col("__t") / F.lit(width)), "__to",
    )
    jump = nxt.filter(~F.col("__row")).select(key, F.col("__from"), F.col("__to")).filter("__to IS NOT NULL")
    reached = times.groupBy(key).agg(F.min("__t").alias("__from"))
    jump, reached = cut_lineage(jump), cut_lineage(reached)
    while True:
        grown = reached.join(jump, [key, "__from"]).select(key, F.col("__to").alias("__from"))
        grown = cut_lineage(reached.unionByName(grown).distinct())
        far = jump.alias("a").join(jump.select(key, F.col("__from").alias("__to"), F.col("__to").alias("__far")), [key, "__to"])
        jump = cut_lineage(far.select(key, "__from", F.col("__far").alias("__to")))
        reached = grown
        if jump.isEmpty():
            break
    both = times.select(key, "__t", F.lit(None).cast("bigint").alias("__a")).unionByName(
        reached.select(key, F.col("__from").alias("__t"), F.col("__from").alias("__a"))
    )
    seen = last_seen(both, [key], [F.col("__t"), F.col("__a").isNull().cast("int")], F.col("__a"), F.floor(F.col("__t") / F.lit(width)), name)
    seen = seen.filter("__a IS NULL").select(key, F.col("__t").alias(at), name)
    return df.join(seen, [key, at], "left")
