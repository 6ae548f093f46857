"""Top-k search and WARC archives against brute force."""

import base64
import gzip
import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from chartmill.llm.vector_topk import build_tree, scaled, search_tree, top_inner_products, usable
from chartmill.llm.warc import archive, look_up, parse_record, read_records, url_key
from chartmill.llm.warc import _spot

VECTORS = "vec_id bigint, embedding array<float>, label int"


def brute_top(rows, queries, k):
    out = []
    for q, v in queries:
        found = sorted((-sum(int(a * b) for a, b in zip(v, w)), i) for i, w in rows if i != q)
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist(), 0) for i in range(300)]
    rows += [(1000 + i, rows[5][1], 0) for i in range(90)]  # one vector very often: ties
    rows += [(2000, None, 0), (2100, [], 0), (2200, [1.0, None, 2.0], 0), (2300, [float("nan")] * 8, 0), (2400, [float("inf")] * 8, 0), (2500, [0.0] * 8, 0), (2600, [3.0, -2.0], 0), (None, [1.0] * 8, 0)]
    frame = spark.createDataFrame(rows, VECTORS).filter(usable(F.col("embedding"))).select("vec_id", scaled(F.col("embedding")).alias("vector"), F.lit(1).alias("tree"))
    kept = [(i, [float(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    got = top_inner_products(frame, frame.filter("vec_id % 100 = 0"), k=10, tree_vectors=64, page_entries=8, query_block=3)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(kept, [(i, v) for i, v in kept if i % 100 == 0], 10)


def test_fewer_candidates_than_asked_for(spark):
    frame = spark.createDataFrame([(0, [1.0]), (100, [2.0]), (7, [-1.0])], "vec_id bigint, vector array<double>")
    assert sorted(tuple(r) for r in top_inner_products(frame, frame, k=10).collect()) == [(0, 1, 100, 2), (0, 2, 7, -1), (7, 1, 0, -1), (7, 2, 100, -2), (100, 1, 0, 2), (100, 2, 7, -2)]
    none = frame.filter("vec_id < 0")
    assert top_inner_products(none, none).collect() == [] and top_inner_products(frame, none).collect() == []


def test_bounds_spare_computations():
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(20, 4)) * 1000
    matrix = np.vstack([c + rng.normal(size=(50, 4)) for c in centers])
    lifted = np.hstack([matrix, np.zeros((len(matrix), 1))])
    pages = build_tree(np.arange(len(matrix)), lifted, 16)
    assert all(len(p["radii"]) <= 16 for p in pages)
    visited = [0]

    class Counted(dict):
        def __getitem__(self, key):
            visited[0] += key == "raw"
            return dict.__getitem__(self, key)

    norm = np.linalg.norm(matrix, axis=1).max()
    full = np.hstack([matrix, np.sqrt(np.maximum(norm ** 2 - (matrix ** 2).sum(axis=1), 0))[:, None]])
    pages = [Counted(p, raw=p["vectors"][:, :-1], double_norm=norm * norm) for p in build_tree(np.arange(len(matrix)), full, 16)]
    search_tree(pages, -1, np.append(matrix[np.linalg.norm(matrix, axis=1).argmax()], 0.0), matrix[np.linalg.norm(matrix, axis=1).argmax()], 3, 1e-6 * norm)
    assert 0 < visited[0] < sum(p["leaf"] for p in pages) / 2


# ---------------------------------------------------------------- archives
def test_url_keys(spark):
    urls = ["http://www.Example.com:80/a?b=1#c", "https://user@b.example.org", "example.com/x y", None, "", "mailto:x@y", "//c.d/"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(url_key(F.col("u"))).collect()]
    assert got == ["com,example)/a?b=1#c", "org,example,b)/", "com,example)/x+y", ")/", ")/", "y)/", "d,c)/"]


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, first string")


def expected(rows, least):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= least and i is not None:
            first[b] = min(i, first.get(b, i))
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        to = first.get(b)
        to = None if to == i else to
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def test_archives_round_trip(spark):
    rng = random.Random(1)
    rows = [(i, f"http://h{rng.randrange(5)}.example/{rng.randrange(30)}", f"<p>{rng.randrange(60)}</p>\r\n\r\n") for i in range(300)]
    rows += [(1000, None, None), (1001, "http://x/\n", ""), (1002, "é", "é" * 200_000), (None, "http://h1.example/1", rows[0][2]), (None, "http://h1.example/1", "only here"), rows[4]]
    pages = pages_of(spark, rows)
    for least in (0, 12):
        store = archive(pages, least, part_lines=70, block_lines=9)
        assert len(store.parts) > 2 and store.directory.count() > 20
        found = look_up(store, pages.select(url_key(F.col("url")).alias("url_key"), "page_id"))
        records = read_records(store, found)
        got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records.collect()), key=str)
        # of repeated rows each is a response: they share the smallest id
        assert got == expected(rows, least)
        payloads = {r.page_id: r.payload for r in records.filter("record_type = 'response'").collect()}
        assert payloads[1002] == "é" * 200_000
    one = look_up(store, spark.createDataFrame([("example,h9)/1", 5), ("zz", None)], "url_key string, page_id bigint"))
    assert one.collect() == []


def test_records_are_members_of_plain_gzip_files(spark):
    store = archive(pages_of(spark, [(1, "http://a/", "x"), (2, "http://b/", "x")]))
    files, root = _spot(f"{store.folder}/warc")
    for c in store.captures.collect():
        with files.open_input_file(f"{root}/{c.file}") as f:
            data = f.read()
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\n")
        assert parse_record(data[c.offset:c.offset + c.length])["page_id"] == c.page_id


def test_no_pages(spark):
    store = archive(pages_of(spark, []))
    assert read_records(store, look_up(store, spark.createDataFrame([("a", 1)], "url_key string, page_id bigint"))).collect() == []
