"""Merkle manifest against a plain build of the trees."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from chartmill.llm.merkle import inclusion_paths, manifest, verify_manifest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, pos int, tree string, level int, digest string, c0 string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def lowered(doc_id, text):
    if doc_id is None or text is None or zlib.crc32(str(doc_id).encode()) % 5:
        return text
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k:k + 16]) for k in range(0, len(levels[-1]), 16)])
    return levels


def path_of(levels, at):
    out = []
    for level in levels[:-1]:
        first = at // 16 * 16
        out.append(("".join(level[first:at]), "".join(level[at + 1:first + 16])))
        at //= 16
    return out


def brute(rows):
    """``rows`` are (doc_id, source, lang, n_chars, text)."""
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf_of(*row), row))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    ordered = {s: sorted(by_source[s], key=lambda x: x[:3]) for s in sources}
    trees = {s: levels_of([x[2] for x in ordered[s]]) for s in sources}
    top = levels_of([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for at, (_, _, leaf, row) in enumerate(ordered[s]):
            path = path_of(trees[s], at) + path_of(top, k)
            folded = leaf_of(*row[:4], lowered(row[0], row[4]))
            for left, right in path:
                folded = H(left, folded, right)
            out.append((row[0], leaf, trees[s][-1][0], top[-1][0], H(*[a + b for a, b in path]), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def got(spark, rows):
    frame = spark.createDataFrame([(i, t, lang, s, n, "x", 1, "y", 2, "z", "w") for i, s, lang, n, t in rows], COLUMNS)
    return sorted([tuple(r) for r in verify_manifest(frame).collect()], key=str)


def test_odd_rows(spark):
    # one source of several levels, one of one leaf, one of 17 leaves, a null and an empty one
    rows = [(i, "hot", "en", i, f"Text {i} Ä") for i in range(300)] + [(1000, "single", None, None, None)]
    rows += [(2000 + i, "run", "de", 3, "ABC") for i in range(17)] + [(3000 + i, None, "fr", 0, "") for i in range(3)] + [(4000, "", "fr", 1, "long " * 40_000)]
    rows += [(None, "hot", "en", 1, "NO ID"), (None, "hot", "en", 1, "NO ID"), (7, "hot", "en", 7, "Text 7 Ä"), (7, "hot", "en", 7, "Other of the same id")]
    rows += [(5000 + i, f"s{i}", "en", 1, "One") for i in range(20)]
    result = got(spark, rows)
    assert result == brute(rows)
    assert {r[-1] for r in result} == {True, False}


@pytest.mark.parametrize("count", [0, 1, 2, 16, 17, 257])
def test_sizes_of_one_source(spark, count):
    rows = [(i, "s", "en", 1, f"Row {i}") for i in range(count)]
    assert got(spark, rows) == brute(rows)


def test_paths_prove_rows_and_nothing_else(spark):
    leaves = spark.range(40).select(F.lit("s").alias("tree"), F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    m = manifest(leaves)
    for row in inclusion_paths(m).collect():
        for start, holds in ((row.digest, True), (H("another"), False)):
            for left, right in row.path:
                start = H(left, start, right)
            assert (start == m.root) is holds
