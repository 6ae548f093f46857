"""SentencePiece codec, token counts and packing against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from chartmill.llm.common import tokenizer_path
from chartmill.llm.packing import across, cut_pieces, pack_documents, ranges, sweep, token_ids
from chartmill.llm.sentencepiece_codec import decode_ids, encode_texts, round_trips
from chartmill.llm.token_counts import count_tokens

LETTERS = "abcdefgeinthrs  \n\t▁éàü漢日🤦.,!?0123 "


def texts(seed, count):
    rng = random.Random(seed)
    fixed = [None, "", " ", "a", " a  b   c ", "\n\n a\n", "a" * 3000, "   " * 20 + "x" + " " * 40, "<s>hi</s> <0x0A> ▁▁ x▁y", "漢字カナ交じり文" * 300, "🤦🏼‍♂️ é́ \x00 \x85 z y",
             "it's <|endoftext|> here<|endoftext|>", "a b c  d", "word " * 30_000, "dup", "dup"]
    return [(k, t) for k, t in enumerate(fixed + ["".join(rng.choices(LETTERS, k=rng.randint(0, 80))) for _ in range(count)])] + [(None, "no id")]


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def byte_pairs():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


def test_ids_are_those_of_the_library(documents, pieces):
    rows = texts(1, 400)
    got = {r.doc_id: (r.ids, r.n_tokens) for r in encode_texts(documents(rows)).collect()}
    for i, t in rows:
        ids = pieces.encode(t or "")
        assert got[i] == (ids, len(ids)), t


def test_decoding_gives_the_text_back(documents, pieces):
    rows = texts(2, 200)
    got = {r.doc_id: r.text for r in decode_ids(encode_texts(documents(rows))).collect()}
    for i, t in rows:
        assert got[i] == pieces.decode(pieces.encode(t or "")) == (t or "").replace("▁", " "), t


def test_round_trips_decode_every_text(documents, pieces):
    rows = texts(9, 200)
    got = {r.doc_id: r for r in round_trips(documents(rows)).collect()}
    assert len(got) == len(rows) and {r.round_trip for r in got.values()} == {True, False}
    for i, t in rows:
        ids, back = pieces.encode(t or ""), pieces.decode(pieces.encode(t or ""))
        assert (got[i].ids, got[i].n_tokens, got[i].decoded_sha256, got[i].round_trip) == (ids, len(ids), hashlib.sha256(back.encode()).hexdigest(), back == (t or "")), t


def test_the_query_decodes_the_whole_table(spark, sf):
    from chartmill.llm.queries import QUERIES

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op3_sentencepiece"](spark, sf).collect()
    assert {r.doc_id for r in rows} == set(docs)
    assert all(r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].replace("▁", " ").encode()).hexdigest() and r.round_trip == ("▁" not in docs[r.doc_id]) for r in rows)


def test_decoding_odd_ids(spark, pieces):
    rows = [(1, None), (2, []), (3, [0, 1, 2, 300]), (4, [3 + 0xE9]), (5, [3 + 0xC3, 3 + 0xA9])]
    got = {r.doc_id: r.text for r in decode_ids(spark.createDataFrame(rows, "doc_id bigint, ids array<int>")).collect()}
    assert got[1] == got[2] == "" and got[4] == "�" and got[5] == "é"


def test_counts_are_those_of_the_library(documents, pieces):
    rows = texts(3, 400)
    got = {r.doc_id: tuple(r)[1:] for r in count_tokens(documents(rows), limit=4096).collect()}
    for i, t in rows:
        n = len(pieces.encode(t or ""))
        assert got[i] == (len((t or "").encode()), n, n > 4096), t


def test_no_rows(documents):
    empty = documents([])
    assert count_tokens(empty).collect() == [] and encode_texts(empty).collect() == [] and pack_documents(empty).collect() == []


# ---------------------------------------------------------------- packing
def test_ids_are_those_of_the_slower_library(byte_pairs):
    rng, latin = random.Random(6), "".join(map(chr, range(256)))
    odd = ["".join(rng.choices(latin, k=rng.randint(0, 60))) for _ in range(2000)] + ["".join(rng.choices("ab \n\t\x85\xa0\x1c\x1f'sre1é", k=rng.randint(0, 40))) for _ in range(2000)]
    for t in [t or "" for _, t in texts(4, 600)] + odd:
        assert token_ids(t, tokenizer_path("byte_bpe_50k.json")).tolist() == byte_pairs.encode(t, add_special_tokens=False).ids, t


def test_cut_pieces():
    assert cut_pieces(1, 8) == [(0, 1)] and cut_pieces(8, 8) == [(0, 8)] and cut_pieces(17, 8) == [(0, 1), (1, 8), (9, 8)]


def stack_matches(rows):
    """Pairs by a plain stack, from the largest size down."""
    stack, out = [], []
    for size, doc, name in sorted(rows, key=lambda r: (-r[0], r[1], r[2])):
        if not doc:
            stack.append(name)
        elif stack:
            out.append((name, stack.pop()))
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_sweeps_over_ranges_are_one_stack(seed):
    rng = random.Random(seed)
    rows = [(rng.randint(1, 30), rng.random() < 0.5, k) for k in range(300)]
    by_range = {}
    cut = {(s, d): at for s, d, at, parts in ranges({(s, d): sum(1 for r in rows if r[:2] == (s, d)) for s, d, _ in rows}, 40) if parts == 1}
    for r in rows:
        by_range.setdefault(cut[r[:2]], []).append(r)
    pairs, left, lone_of, free_of = [], [], {}, {}
    for part in sorted(by_range):
        size, doc, name = map(np.array, zip(*by_range[part]))
        docs, slots, lone, free = sweep(size, doc, name)
        pairs += zip(name[docs].tolist(), name[slots].tolist())
        lone_of[part], free_of[part] = name[lone].tolist(), name[free].tolist()
        left.append((part, len(lone), len(free)))
    for part, a, where, b, n in across(left):
        pairs += zip(lone_of[part][a:a + n], free_of[where][b:b + n])
    assert sorted(pairs) == stack_matches(rows)


def test_a_size_with_many_rows_gets_several_ranges():
    assert ranges({(9, False): 5, (9, True): 250, (3, True): 7}, 100) == [(9, False, 0, 1), (9, True, 1, 3), (3, True, 4, 1)]


@pytest.mark.parametrize("range_rows", [7, 100_000])
def test_packing(documents, byte_pairs, range_rows):
    rng = random.Random(9)
    rows = texts(5, 60) + [(1000 + k, " ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.randint(1, 60)))) for k in range(150)]
    capacity = 64
    got = pack_documents(documents(rows), capacity, range_rows).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == {i for i, _ in rows}
    for i, t in rows:
        ids = byte_pairs.encode(t or "", add_special_tokens=False).ids + [0]
        mine = sorted(by_doc[i], key=lambda r: r.piece)
        assert [(r.start, r.length) for r in mine] == cut_pieces(len(ids), capacity)
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], dtype="<u4").tobytes())
    for rs in by_sequence.values():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == [sum(x.length for x in rs[:k]) for k in range(len(rs))]
        assert sum(r.length for r in rs) <= capacity
    total = sum(r.length for r in got)
    assert len(by_sequence) <= 1.03 * -(-total // capacity) + 2
