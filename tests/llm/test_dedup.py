"""Exact dedup, line dedup and the Jaccard join against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartmill.llm.exact_dedup import drop_copies, exact_groups
from chartmill.llm.jaccard_join import bands_of, drop_near_copies, jaccard_components, shingle_set, signatures
from chartmill.llm.line_dedup import dedup_lines, dedup_passages

ROWS = [(1, "a b"), (2, "ab"), (3, "a\tb\n"), (4, ""), (5, None), (6, " \n"), (None, "ab"), (7, "ab c"), (7, "ab c"), (8, "é" * 50_000), (9, "é" * 50_000 + " "), (10, "ab ")]


def expected_groups(rows):
    body = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    out = []
    for (i, _), b in zip(rows, body):
        like = [(-len(t or ""), j is None, j or 0, j) for (j, t), c in zip(rows, body) if c == b]
        keep = min(like)[3]
        out.append((i, keep, len(like), i == keep, hashlib.sha256(b.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("content_hash", [F.md5, lambda c: F.substring(F.md5(c), 1, 1), lambda c: F.lit("same")])
def test_exact_groups_whatever_the_hash(documents, content_hash):
    got = [tuple(r) for r in exact_groups(documents(ROWS), content_hash).collect()]
    assert sorted(got, key=str) == expected_groups(ROWS)


def test_drop_copies_keeps_columns_and_one_of_repeated_rows(documents):
    docs = documents(ROWS)
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 6, 7, 9, 10]


def test_no_rows(documents):
    empty = documents([])
    assert exact_groups(empty).collect() == [] and drop_copies(empty).collect() == []
    assert dedup_lines(empty).collect() == [] and jaccard_components(empty).collect() == [] and drop_near_copies(empty).collect() == []


# ---------------------------------------------------------------- lines
def expected_lines(rows, chunk_lines=3, least_words=20):
    def line_hash(line):
        return int(hashlib.md5(line.encode()).hexdigest()[:7], 16)

    cut = []
    for i, t in rows:
        lines = (t or "").split("\n")
        marks = [(line_hash(line) + 31 * (line_hash(lines[k - 1]) if k else 0)) % 1_000_003 % chunk_lines == 0 for k, line in enumerate(lines)]
        ends = [k for k in range(len(lines)) if k == len(lines) - 1 or marks[k] and not (k and marks[k - 1])]
        chunks = [(a, e + 1) for a, e in zip([0, *[e + 1 for e in ends[:-1]]], ends)]
        units = [(c, *chunks[c]) for c in range(len(chunks)) if chunks[c][1] - chunks[c][0] >= 2 and any(x.strip(" ") for x in lines[slice(*chunks[c])])]
        units += [(c, k, k + 1) for c in range(len(chunks)) for k in range(*chunks[c]) if len(lines[k].split()) >= least_words]
        cut.append((i, lines, [(a, b, chunks[max(0, c - 2)][0], chunks[min(len(chunks) - 1, c + 2)][1]) for c, a, b in units]))
    first = {}
    for i, lines, units in sorted((c for c in cut if c[0] is not None), key=lambda c: c[0]):
        for u in sorted(units):
            first.setdefault("\n".join(lines[u[0]:u[1]]), (i, lines, u))
    out = []
    for i, lines, units in cut:
        removed = [(u, first["\n".join(lines[u[0]:u[1]])]) for u in units if i is not None and first["\n".join(lines[u[0]:u[1]])][::2] != (i, u)]
        covered = {k for u, _ in removed for k in range(u[0], u[1])}
        grown = set()
        for (a, b, low, high), (_, theirs, (fa, fb, flow, fhigh)) in removed:
            for here, there, step, inside in ((a - 1, fa - 1, -1, lambda k, q: k >= low and q >= flow), (b, fb, 1, lambda k, q: k < high and q < fhigh)):
                while inside(here, there) and here not in covered and lines[here] == theirs[there]:
                    grown.add(here)
                    here, there = here + step, there + step
        gone = covered | grown
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone), len(removed)))
    return sorted(out, key=str)


def test_lines_against_brute_force(documents):
    rng = random.Random(5)
    lines = [f"line {k} {rng.random()}" for k in range(60)] + ["", " "] + [" ".join(f"v{rng.random()}" for _ in range(25)) for _ in range(6)]
    passage = lines[:25]
    rows = [(k, "\n".join([*rng.choices(lines[30:], k=rng.randint(0, 8)), *(passage if k % 3 else []), *rng.choices(lines, k=rng.randint(0, 8))])) for k in range(40)]
    rows += [(100, None), (101, ""), (102, rows[3][1]), (None, rows[3][1]), (103, "\n" * 20), (104, "\n" * 20), (105, "\n".join(passage * 3)), (106, "x\n" * 30_000)]
    got = sorted((tuple(r) for r in dedup_lines(documents(rows)).collect()), key=str)
    assert got == expected_lines(rows)
    removed = dedup_lines(documents(rows)).agg(F.sum("removed_lines"), F.sum("removed_chunks")).first()
    assert removed[0] > 2 * removed[1] > 0
    # the first place of every line stays
    left = {line for _, t, *_ in got for line in t.split("\n")}
    assert {line for _, t in rows for line in (t or "").split("\n") if line.strip()} <= left


def test_short_passages_go_as_a_whole(documents):
    rng = random.Random(6)
    for n in (2, 3, 4, 12):
        passage = [" ".join(f"p{k}{rng.random()}" for _ in range(26 if k == n // 2 else 9)) for k in range(n)]
        rows = [(d, "\n".join([*[f"own {d} {k} {rng.random()}" for k in range(9)], *passage, *[f"own {d} {k} {rng.random()}" for k in range(9)]])) for d in range(20)]
        got = {r.doc_id: r.removed_lines for r in dedup_lines(documents(rows)).collect()}
        assert got == {d: n if d else 0 for d in range(20)}


def test_repeated_row_keeps_its_own_lines(documents):
    text = "\n".join(f"only here {k}" for k in range(30))
    got = dedup_lines(documents([(1, text), (1, text)])).collect()
    assert [r.text for r in got] == [text, text]


def expected_passages(rows, least_words=20):
    units = []
    for i, t in rows:
        lines = (t or "").split("\n")
        at = [k for k, line in enumerate(lines) if line.strip(" \t\n\v\f\r")]
        pairs = [(k, range(a, b + 1)) for k, (a, b) in enumerate(zip(at, at[1:]))]
        units.append((i, t, lines, pairs + [(k, range(a, a + 1)) for k, a in enumerate(at) if len(lines[a].split()) >= least_words]))
    first = {}
    for i, t, lines, us in sorted((u for u in units if u[0] is not None), key=lambda u: u[0]):
        for k, span in sorted(us, key=lambda u: u[0]):
            first.setdefault("\n".join(lines[s] for s in span), (i, k))
    out = []
    for i, t, lines, us in units:
        gone = {s for k, span in us for s in span if i is not None and first["\n".join(lines[s] for s in span)] != (i, k)}
        out.append((i, "\n".join(x for s, x in enumerate(lines) if s not in gone), len(lines), len(gone)))
    return sorted(out, key=str)


def test_passages_go_whatever_their_length_and_place(documents):
    long = " ".join(f"w{k}" for k in range(20))
    rows = [(1, f"a\n{long}\nb"), (2, f"c\n{long}\nd"), (3, "one\n\ntwo\nthree"), (4, "x\none\n\ntwo\nthree\ny"), (5, "two"), (6, "z\ntwo\nthree")]
    got = {r.doc_id: r.text for r in dedup_passages(documents(rows)).collect()}
    assert got == {1: rows[0][1], 2: "c\nd", 3: rows[2][1], 4: "x\ny", 5: "two", 6: "z"}


def test_passages_against_brute_force(documents):
    rng = random.Random(6)
    lines = [f"line {k} {rng.random()}" for k in range(60)] + ["", " "] + [" ".join(f"v{rng.random()}" for _ in range(25)) for _ in range(6)]
    rows = [(k, "\n".join([*rng.choices(lines, k=rng.randint(0, 8)), *(lines[:12] if k % 3 else []), *rng.choices(lines, k=rng.randint(0, 8))])) for k in range(40)]
    rows += [(100, None), (101, ""), (102, rows[3][1]), (102, rows[3][1]), (None, rows[3][1]), (103, "\n" * 20), (104, "\n" * 20), (105, "\n".join(lines[:25] * 3)), (106, "x\n" * 30_000)]
    got = [tuple(r) for r in dedup_passages(documents(rows)).collect()]
    assert sorted(got, key=str) == expected_passages(rows)
    assert dedup_passages(documents([])).collect() == []
    # the first place of every line stays
    left = {line for i, t, *_ in got for line in t.split("\n")}
    assert {line for _, t in rows for line in (t or "").split("\n") if line.strip()} <= left


# ---------------------------------------------------------------- Jaccard
def brute_components(rows, width, num, den):
    sets, root = [], {}
    for i, t in rows:
        w = [x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
        sets.append((i, {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()))

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and den * len(s & t) >= num * len(s | t):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def near_copies(rng, count, words):
    out = []
    for k in range(count):
        base = rng.choices(words, k=rng.choice([1, 2, 3, 5, 12, 40, 150]))
        for _ in range(rng.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(words)
            out.append(" ".join(w))
    # one family that is larger than what is paired set by set
    base = rng.choices(words, k=120)
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    # and a passage that many otherwise different texts share
    out += [" ".join([*rng.choices(words, k=60), *base[:50], *rng.choices(words, k=30)]) for _ in range(40)]
    return [(k, t) for k, t in enumerate(out)]


@pytest.mark.parametrize("width,num", [(3, 90), (5, 80)])
def test_components_against_brute_force(documents, width, num):
    rng = random.Random(num)
    rows = near_copies(rng, 120, [f"w{k}" for k in range(400)])
    rows += [(9000, None), (9001, ""), (9002, "\n \t"), (9003, rows[0][1].upper()), (None, rows[0][1]), (9004, "É a b c"), (9005, "é a b c"), rows[5], (9006, "x " * 60_000)]
    got = jaccard_components(documents(rows), width, num, 100, block_sets=4)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_components(rows, width, num, 100)


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(3)
    for num in (80, 90):
        bands = bands_of(num, 100)
        for _ in range(400):
            base = rng.integers(0, 2**63, rng.integers(1, 300), dtype=np.uint64)
            other = base.copy()
            change = rng.choice(len(base), int(len(base) * rng.uniform(0, 0.12)), replace=False)
            other[change] = rng.integers(0, 2**63, len(change), dtype=np.uint64)
            a, b = np.unique(base), np.unique(other)
            shared = len(np.intersect1d(a, b))
            if 100 * shared >= num * (len(a) + len(b) - shared):
                (one, _, needed), (two, _, also) = signatures([a], bands), signatures([b], bands)
                assert len(np.intersect1d(one, two)) >= min(max(needed.min(), 1), max(also.min(), 1))


def test_shingles_of_short_texts():
    assert len(shingle_set("", 3)) == 0 and len(shingle_set("a b", 3)) == 1 and len(shingle_set("a b c a b c", 3)) == 3


def test_one_of_each_group_stays(documents):
    text = " ".join(f"w{k}" for k in range(200))
    docs = documents([(3, text), (2, text + " z"), (5, "other words here"), (None, text)])
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [2, 5, None]
