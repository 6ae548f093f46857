"""Hard-negative mining over an inverted multi-index."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartmill.llm.common import with_python, write_table

# rows that a cell should have, most codes of a half, most rows the codebooks are fitted on
CELL_ROWS = 512
MOST_CODES = 512
SAMPLE_ROWS = 20_000
# bytes and rows of a page, a part of a cell; anchors that meet a page at once
PAGE_BYTES, PAGE_ROWS = 16 << 20, 4096
ANCHOR_BLOCK = 2048
# rows that an anchor's first round covers, and how much more each later round does
FIRST_ROWS, GROWTH = 2048, 8
# relative rounding of a bound
SLACK = 1e-9


def _matrix(vectors, width: int) -> np.ndarray:
    """Rows of one width; shorter vectors end in zeros."""
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        row[:len(v)] = v
    return out


# ---------------------------------------------------------------- codebooks
def _nearest(points: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest code of each point, and its distance."""
    number = np.empty(len(points), dtype=np.int64)
    squares = np.einsum("ij,ij->i", codes, codes)
    for k in range(0, len(points), 4096):
        number[k:k + 4096] = np.argmin(squares - 2 * points[k:k + 4096] @ codes.T, axis=1)
    apart = points - codes[number]
    return number, np.sqrt(np.einsum("ij,ij->i", apart, apart))


def fit_codes(points: np.ndarray, count: int, steps: int = 6) -> np.ndarray:
    """Means of ``count`` clusters at most, started from distinct points in their order."""
    if not points.size:
        return np.zeros((1, points.shape[1]))
    distinct = points[np.sort(np.unique(points, axis=0, return_index=True)[1])]
    codes = distinct[np.linspace(0, len(distinct) - 1, min(count, len(distinct))).astype(int)]
    for _ in range(steps):
        owner, _ = _nearest(points, codes)
        size = np.bincount(owner, minlength=len(codes))
        total = np.zeros_like(codes)
        np.add.at(total, owner, points)
        codes = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], codes)
    return codes


@dataclass(frozen=True)
class Cells:
    """Codes and covering radii of both halves, and rows per cell; a cell's number is ``first * number of second codes + second``."""

    width: int
    codes: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    sizes: np.ndarray
    page_rows: int

    def half_bounds(self, vector: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
        """Least and largest inner product that each code's half can give, per half."""
        out, at = [], 0
        for codes, radii in zip(self.codes, self.radii):
            q = vector[at:at + codes.shape[1]]
            at += codes.shape[1]
            length = math.sqrt(q @ q)
            middle, reach = codes @ q, length * radii
            reach = reach + SLACK * (1 + reach + length * np.sqrt(np.einsum("ij,ij->i", codes, codes)))
            out.append((middle - reach, middle + reach))
        return tuple(out)


@dataclass(frozen=True)
class Index:
    """The cells, all rows with their codes, and the pages ``(cell, page, ids, labels, vectors)``."""

    cells: Cells
    rows: DataFrame
    pages: DataFrame


def cells_in_order(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """Pairs of codes by falling sum of their bounds: the multi-sequence walk over both sorted lists."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    heap = [(-(x[0] + y[0]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, int(a[i]), int(b[j])
        if j + 1 < len(y):
            heapq.heappush(heap, (-(x[i] + y[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (-(x[i + 1] + y[0]), i + 1, 0))


def build_index(rows: DataFrame, cell_rows: int = CELL_ROWS, page_rows: int | None = None, sample_rows: int = SAMPLE_ROWS) -> Index:
    """Inverted multi-index over all ``rows(vec_id, label, vector)``.

    The codebooks are fitted on the ``sample_rows`` rows that come first by
    the hash of their id; every row is indexed and counts in the radii. The
    number of codes grows with the root of the rows up to ``MOST_CODES``, so
    what the driver holds (codes, radii, rows per cell) is bounded. A cell
    with many rows is spread over pages, whatever its vectors are.
    """
    spark = rows.sparkSession
    total, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    count = min(MOST_CODES, max(1, math.ceil(math.sqrt(total / cell_rows))))
    half = width // 2
    sample = _matrix([r.vector for r in rows.select("vec_id", "vector").orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(sample_rows).collect()], width)
    codes = fit_codes(sample[:, :half], count), fit_codes(sample[:, half:], count)
    seconds = len(codes[1])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            matrix = _matrix(batch.vector, width)
            a, to_a = _nearest(matrix[:, :half], codes[0])
            b, to_b = _nearest(matrix[:, half:], codes[1])
            yield batch.assign(cell=a * seconds + b, first=a, second=b, to_first=to_a, to_second=to_b)

    coded = with_python(rows).mapInPandas(assign, "vec_id bigint, label bigint, vector array<double>, cell bigint, first bigint, second bigint, to_first double, to_second double")
    placed = write_table(coded.withColumn("row", F.monotonically_increasing_id()), "multi-index-rows")
    # at most MOST_CODES rows each, and their product
    radii = []
    for code, apart, k in (("first", "to_first", 0), ("second", "to_second", 1)):
        found = np.zeros(len(codes[k]))
        for r in placed.groupBy(code).agg(F.max(apart).alias("r")).collect():
            found[r[code]] = r.r
        radii.append(found)
    counts = placed.groupBy("cell").agg(F.count("*").alias("size"))
    sizes = np.zeros(len(codes[0]) * seconds, dtype=np.int64)
    for r in counts.collect():
        sizes[r.cell] = r["size"]
    page_rows = page_rows or max(1, min(PAGE_ROWS, PAGE_BYTES // (8 * max(width, 1))))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        matrix = _matrix(group.vector, width)
        return pd.DataFrame([(int(group.cell.iloc[0]), int(group.page.iloc[0]), group.vec_id.to_numpy(np.int64).tobytes(), group.label.to_numpy(np.int64).tobytes(), matrix.tobytes())],
                            columns=["cell", "page", "ids", "labels", "vectors"])

    # bounded: a row per cell
    paged = placed.join(F.broadcast(counts), "cell").withColumn("page", F.col("row") % F.ceil(F.col("size") / page_rows))
    pages = paged.select("cell", "page", "vec_id", "label", "vector").groupBy("cell", "page").applyInPandas(pack, "cell bigint, page bigint, ids binary, labels binary, vectors binary")
    return Index(Cells(width, codes, tuple(radii), sizes.reshape(len(codes[0]), seconds), page_rows), placed, write_table(pages, "multi-index-pages"))


# ---------------------------------------------------------------- search
ASKED = "anchor bigint, block int, vec_id bigint, label bigint, vector array<double>, highs array<double>, floors array<double>"
FOUND = "anchor bigint, slot int, vec_id bigint, score double"


def _first_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to smaller ids."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def search(index: Index, anchors: DataFrame, k: int, low: float, first_rows: int = FIRST_ROWS) -> DataFrame:
    """The ``k`` highest rows per anchor and window: ``anchor, slot, vec_id, score``.

    ``anchors`` is ``(anchor, block, vec_id, label, vector, highs)``. Without
    ``highs`` there is one window, all other rows of the anchor's label; with
    them window ``slot`` holds the rows of other labels that score from ``low``
    to 1 times ``highs[slot]``.

    In each round an anchor walks on over the cells by falling bound, until
    the cells of the round hold enough rows, or no cell that follows can reach
    a window's k-th score or lower end: then all its windows are certified.
    Cells whose scores all lie above the windows are passed over. The cells'
    pages meet the anchors that ask for them, block by block; anchors of a
    block lie near one another, so a page is copied for few blocks. Rounds
    grow, so there are few of them.
    """
    spark = anchors.sparkSession
    anchors = with_python(anchors)
    space = index.cells
    seconds = space.sizes.shape[1]

    def plan(budget: int):
        def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for r in batch.itertuples():
                    q = np.zeros(space.width)
                    v = np.asarray(r.vector)[:space.width]
                    q[:len(v)] = v
                    floors = np.asarray(r.floors, dtype=float)
                    need = floors.min() if len(floors) else math.inf
                    top = max(r.highs) if r.highs is not None else math.inf
                    (low_a, high_a), (low_b, high_b) = space.half_bounds(q)
                    cells, rows, seen, open_ = [], 0, 0, False
                    for bound, i, j in cells_in_order(high_a, high_b):
                        if bound < need:
                            break
                        if rows >= budget:
                            open_ = True
                            break
                        seen += 1
                        if seen <= r.seen or not space.sizes[i, j] or low_a[i] + low_b[j] > top:
                            continue
                        cells.append((i * seconds + j, -(-int(space.sizes[i, j]) // space.page_rows)))
                        rows += int(space.sizes[i, j])
                    if cells:
                        out.append((r.anchor, r.block, r.vec_id, r.label, r.vector, r.highs, r.floors, seen, open_, [c for c, _ in cells], [p for _, p in cells]))
                yield pd.DataFrame(out, columns=["anchor", "block", "vec_id", "label", "vector", "highs", "floors", "seen", "open", "cells", "pages"])
        return step

    def meet(page: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if page.empty or asked.empty:
            return pd.DataFrame({n: pd.Series(dtype=t) for n, t in (("anchor", "int64"), ("slot", "int32"), ("vec_id", "int64"), ("score", "float64"))})
        row = page.iloc[0]
        ids, labels = (np.frombuffer(row[c], dtype=np.int64) for c in ("ids", "labels"))
        scores = _matrix([v[:space.width] for v in asked.vector], space.width) @ np.frombuffer(row.vectors).reshape(len(ids), -1).T
        out = []
        for line, r in zip(scores, asked.itertuples()):
            same = (labels == r.label) & (ids != r.vec_id)
            if r.highs is None:
                windows = [same & (line >= r.floors[0])]
            else:
                other = (labels != r.label) & (ids != r.vec_id)
                windows = [other & (line <= high) & (line >= floor) for high, floor in zip(r.highs, r.floors)]
            for slot, inside in enumerate(windows):
                at = np.flatnonzero(inside)
                at = at[_first_of(line[at], ids[at], k)]
                out += [(r.anchor, slot, i, s) for i, s in zip(ids[at].tolist(), line[at].tolist())]
        return pd.DataFrame(out, columns=["anchor", "slot", "vec_id", "score"])

    # what a window can need at all: its lower end, or anything
    none = F.lit(-math.inf)
    start = F.when(F.col("highs").isNull(), F.array(none)).otherwise(F.transform("highs", lambda h: F.when(h >= 0, F.ceil(h * low - SLACK).cast("double")).otherwise(math.inf)))
    asking = anchors.select("anchor", "block", "vec_id", "label", "vector", "highs", start.alias("floors"), F.lit(0).alias("seen"))
    found = spark.createDataFrame([], FOUND)
    budget = first_rows
    while True:
        planned = write_table(asking.mapInPandas(plan(budget), f"{ASKED}, seen int, open boolean, cells array<bigint>, pages array<bigint>"), "multi-index-plan")
        if planned.isEmpty():
            break
        cell = F.explode(F.arrays_zip("cells", "pages")).alias("c")
        asked = planned.select("anchor", "block", "vec_id", "label", "vector", "highs", "floors", cell)
        # new columns, not those of the other side of the cogroup
        pairs = asked.select((F.col("c.cells") + 0).alias("cell"), (F.col("block") + 0).alias("block")).distinct()
        asked = asked.select("*", F.col("c.cells").alias("cell"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("c.pages") - 1)).alias("page")).drop("c")
        keys = ["cell", "page", "block"]
        met = index.pages.join(pairs, "cell").groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(meet, FOUND)
        place = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id"))
        found = write_table(found.unionByName(met).withColumn("place", place).filter(F.col("place") <= k).drop("place"), "multi-index-found")
        # the k-th score of a window is what a further row has to reach
        kth = found.groupBy("anchor", "slot").agg(F.count("*").alias("n"), F.min("score").alias("s")).filter(F.col("n") == k)
        kth = kth.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "s"))).alias("kth"))
        asking = planned.filter("open").select("anchor", "block", "vec_id", "label", "vector", "highs", "floors", "seen").join(kth, "anchor", "left")
        raised = F.transform("floors", lambda f, i: F.greatest(f, F.coalesce(F.try_element_at("kth", i), none)))
        asking = asking.withColumn("floors", raised).drop("kth")
        budget *= GROWTH
    return found


def mine_hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: float = 0.8, cell_rows: int = CELL_ROWS, page_rows: int | None = None,
                        first_rows: int = FIRST_ROWS, anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """Hard negatives: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` is ``(vec_id, label, vector)`` with whole-number components. An
    anchor's positives are the other rows of its label with the highest inner
    products; for each of them the negatives are the highest rows of other
    labels that score from ``low`` to 1 times the positive's score. Ties go to
    smaller ids. Both searches are exact: an anchor stops only when no cell
    left can hold a row that counts (``search``).

    Rows with a null id, label or vector take no part. Rows that share an
    anchor's id are not its partners; repeated rows are candidates of their
    own, and repeated anchors are asked each. Shorter vectors end in zeros.
    A negative positive score has no window. An anchor without positives, or
    a positive without negatives, has no rows; neither has an empty table.
    Extra columns are not read. Scores are exact while the products of the
    lengths of two vectors stay below 2^53.
    """
    used = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).select("vec_id", F.col("label").cast("bigint").alias("label"), "vector")
    index = build_index(used, cell_rows, page_rows)
    chosen = index.rows.filter(is_anchor)
    blocks = max(1, -(-chosen.count() // anchor_block))
    anchors = chosen.select(F.col("row").alias("anchor"), "vec_id", "label", "vector", "first", "second").repartitionByRange(blocks, "first", "second", "anchor")
    anchors = write_table(anchors.select("anchor", F.spark_partition_id().alias("block"), "vec_id", "label", "vector"), "multi-index-anchors")
    near = search(index, anchors.withColumn("highs", F.lit(None).cast("array<double>")), positives, low, first_rows)
    best = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id")))
    with_windows = anchors.join(near.groupBy("anchor").agg(best.alias("positives")), "anchor")
    with_windows = write_table(with_windows.withColumn("highs", F.transform("positives", lambda p: -p["minus"])), "multi-index-positives")
    far = search(index, with_windows.drop("positives"), negatives, low, first_rows)
    named = far.withColumnRenamed("vec_id", "negative_id").join(with_windows.select("anchor", F.col("vec_id").alias("anchor_id"), "positives"), "anchor")
    positive = F.get("positives", F.col("slot"))
    rank = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "negative_id"))
    return named.withColumn("rank", rank).select(
        "anchor_id", positive["vec_id"].alias("positive_id"), "rank", "negative_id", (-positive["minus"]).cast("bigint").alias("positive_score"), F.col("score").cast("bigint").alias("negative_score")
    )
