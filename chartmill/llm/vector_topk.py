"""Exact top-k search by inner product over M-trees."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartmill.llm.common import with_python, write_table

# vectors of one tree, entries of one page, queries that meet a tree at once
TREE_VECTORS = 8192
PAGE_ENTRIES = 64
QUERY_BLOCK = 2048
PAGES = "tree long, page int, leaf boolean, ids binary, vectors binary, radii binary, parent_distances binary, children binary"


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, no null, no NaN and no infinite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def scaled(vector: Column, factor: int = 1024) -> Column:
    """Each component x as floor(factor * x), x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("double"))


# ---------------------------------------------------------------- one tree
def _lifted(matrix: np.ndarray, norm: float) -> np.ndarray:
    """Vectors with one more component that gives all of them the length ``norm``.

    Between these the largest inner product with a query is the smallest
    Euclidean distance, and that is a metric.
    """
    rest = np.sqrt(np.maximum(norm * norm - np.einsum("ij,ij->i", matrix, matrix), 0.0))
    return np.hstack([matrix, rest[:, None]])


def _distances(points: np.ndarray, center: np.ndarray) -> np.ndarray:
    apart = points - center
    return np.sqrt(np.einsum("ij,ij->i", apart, apart))


def build_tree(ids: np.ndarray, matrix: np.ndarray, page_entries: int = PAGE_ENTRIES) -> list[dict]:
    """Pages of an M-tree over the rows of ``matrix``, page 0 the root.

    A page holds entries: a routing vector, the covering radius of what lies
    below it, its distance to the page's own routing vector and the child page;
    in a leaf the vectors themselves. Vectors are split among far-apart pivots
    until they fit a page, so pages are bounded and the tree is built top down.
    """
    pages: list[dict] = []

    def place(rows: np.ndarray, center: np.ndarray | None) -> int:
        number = len(pages)
        pages.append({})
        if len(rows) <= page_entries:
            near = matrix[rows]
            to_parent = _distances(near, center) if center is not None else np.zeros(len(rows))
            pages[number] = {"leaf": True, "ids": ids[rows], "vectors": near, "radii": np.zeros(len(rows)), "parent_distances": to_parent, "children": np.full(len(rows), -1, dtype=np.int64)}
            return number
        wanted = min(page_entries, -(-len(rows) // (page_entries // 2)))
        # farthest-first pivots; equal vectors give none further, then rows are dealt in turn
        pivots, apart, owner = [], np.full(len(rows), np.inf), np.zeros(len(rows), dtype=np.int64)
        at = 0
        while len(pivots) < wanted:
            d = _distances(matrix[rows], matrix[rows[at]])
            owner[d < apart] = len(pivots)
            apart = np.minimum(apart, d)
            pivots.append(rows[at])
            at = int(np.argmax(apart))
            if apart[at] == 0:
                break
        groups = [rows[owner == k] for k in range(len(pivots))]
        if len(pivots) == 1 or max(map(len, groups)) == len(rows):
            groups = [rows[k::wanted] for k in range(wanted)]
        groups = [g for g in groups if len(g)]
        centers = np.array([matrix[g].mean(axis=0) for g in groups])
        radii = np.array([_distances(matrix[g], c).max() for g, c in zip(groups, centers)])
        children = np.array([place(g, c) for g, c in zip(groups, centers)])
        to_parent = _distances(centers, center) if center is not None else np.zeros(len(groups))
        pages[number] = {"leaf": False, "ids": np.full(len(groups), -1, dtype=np.int64), "vectors": centers, "radii": radii, "parent_distances": to_parent, "children": children}
        return number

    if len(ids):
        place(np.arange(len(ids)), None)
    return pages


def search_tree(pages: list[dict], query_id: int, query: np.ndarray, raw: np.ndarray, k: int, slack: float) -> list[tuple[int, int]]:
    """The k best ``(-score, id)`` of a tree, best first.

    Pages are visited by their least possible distance. An entry whose stored
    distance to its parent already shows that it is too far is passed over
    without a distance computation; ``slack`` covers rounding, so nothing that
    ties with the k-th is lost. Scores are inner products of whole numbers.
    """
    best: list[tuple[int, int]] = []  # a heap, worst on top, of (score, -id)
    bound = np.inf
    queue: list[tuple[float, int, float]] = [(0.0, 0, -1.0)] if pages else []
    reach = float(query @ query)
    while queue:
        least, number, to_center = heapq.heappop(queue)
        if least > bound + slack:
            break
        page = pages[number]
        if to_center >= 0:
            open_ = np.abs(to_center - page["parent_distances"]) - page["radii"] <= bound + slack
            entries = np.flatnonzero(open_)
        else:
            entries = np.arange(len(page["radii"]))
        if not len(entries):
            continue
        if page["leaf"]:
            scores = page["raw"][entries] @ raw
            for score, i in zip(scores.tolist(), page["ids"][entries].tolist()):
                if i == query_id:
                    continue
                item = (int(score), -i)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k:
                # squared distance of lifted vectors of one length: 2 norm^2 - 2 score
                bound = np.sqrt(max(0.0, page["double_norm"] + reach - 2.0 * best[0][0]))
        else:
            d = _distances(page["vectors"][entries], query)
            for e, x, r in zip(entries.tolist(), d.tolist(), page["radii"][entries].tolist()):
                if x - r <= bound + slack:
                    heapq.heappush(queue, (max(0.0, x - r), int(page["children"][e]), x))
    return sorted((-s, -i) for s, i in best)


# ---------------------------------------------------------------- Spark
def _matrix(vectors, width: int) -> np.ndarray:
    """Rows of one width; shorter vectors end in zeros."""
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        row[:len(v)] = v
    return out


def build_index(vectors: DataFrame, tree_vectors: int = TREE_VECTORS, page_entries: int = PAGE_ENTRIES) -> DataFrame:
    """Pages of M-trees over ``vectors(vec_id, vector)``: one tree per ``tree_vectors`` rows or so, dealt by the hash of the id."""
    total, width, norm = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0)), F.coalesce(F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)), F.lit(0.0))).first()
    trees = max(1, -(-total // tree_vectors))
    norm = float(np.sqrt(norm))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        pages = build_tree(group.vec_id.to_numpy(np.int64), _lifted(_matrix(group.vector, width), norm), page_entries)
        return pd.DataFrame([
            (int(group.tree.iloc[0]), n, p["leaf"], *(np.ascontiguousarray(p[c]).tobytes() for c in ("ids", "vectors", "radii", "parent_distances", "children")))
            for n, p in enumerate(pages)
        ], columns=["tree", "page", "leaf", "ids", "vectors", "radii", "parent_distances", "children"])

    dealt = vectors.withColumn("tree", F.pmod(F.xxhash64("vec_id"), F.lit(trees)))
    return with_python(dealt).groupBy("tree").applyInPandas(build, PAGES)


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int = 10, tree_vectors: int = TREE_VECTORS, page_entries: int = PAGE_ENTRIES, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k largest inner products of each query: ``query_id, rank, vec_id, score``.

    ``vectors`` and ``queries`` are ``(vec_id, vector)`` with whole-number
    components; a query does not find its own id, ties go to the smaller id,
    and a query with fewer candidates finds all of them. The index is one
    M-tree per few thousand vectors, kept as a table of pages. Every block of
    queries meets every tree once; a task holds one tree and one block. Trees
    answer with k rows a query at most, which a window merges.

    Vectors shorter than the longest count as ending in zeros. Repeated ids
    are candidates of their own. No vectors or no queries give no rows.
    """
    spark = vectors.sparkSession
    vectors, queries = (df.filter(F.col("vec_id").isNotNull()).select("vec_id", "vector") for df in (vectors, queries))
    pages = write_table(build_index(vectors, tree_vectors, page_entries), "metric-pages")
    width, norm = vectors.agg(F.coalesce(F.max(F.size("vector")), F.lit(0)), F.coalesce(F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)), F.lit(0.0))).first()
    total = queries.count()
    blocks = max(1, -(-total // query_block))
    trees = pages.agg(F.coalesce(F.max("tree") + 1, F.lit(0))).first()[0]
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)))
    every = spark.range(trees * blocks).select((F.col("id") % max(trees, 1)).alias("tree"), F.floor(F.col("id") / max(trees, 1)).alias("block"))
    asked = dealt.join(every, "block")
    stored = pages.join(every.select((F.col("tree") + 0).alias("tree"), (F.col("block") + 0).alias("block")), "tree")
    norm = float(np.sqrt(norm))

    def search(page_rows: pd.DataFrame, asked_rows: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if page_rows.empty or asked_rows.empty:
            return pd.DataFrame({n: pd.Series(dtype="int64") for n in names})
        pages = []
        for row in page_rows.sort_values("page").itertuples():
            radii = np.frombuffer(row.radii)
            page = {"leaf": row.leaf, "ids": np.frombuffer(row.ids, dtype=np.int64), "vectors": np.frombuffer(row.vectors).reshape(len(radii), -1), "radii": radii,
                    "parent_distances": np.frombuffer(row.parent_distances), "children": np.frombuffer(row.children, dtype=np.int64), "double_norm": norm * norm}
            page["raw"] = page["vectors"][:, :-1]
            pages.append(page)
        out = []
        wide = max([width, *map(len, asked_rows.vector)])
        for i, q in zip(asked_rows.vec_id, _matrix(asked_rows.vector, wide)):
            q = q[:width]
            # rounding of a distance grows with the lengths of both vectors
            slack = 1e-6 * (norm + float(np.sqrt(q @ q)) + 1)
            out += [(i, v, -s) for s, v in search_tree(pages, int(i), np.append(q, 0.0), q, k, slack)]
        return pd.DataFrame(out, columns=names)

    found = stored.groupBy("tree", "block").cogroup(asked.groupBy("tree", "block")).applyInPandas(search, "query_id bigint, vec_id bigint, score bigint")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
