"""Token counts by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from chartmill.llm import pieces as P
from chartmill.llm.common import slices, text_of, tokenizer_path, with_python

# most symbols of a word that is merged in step with others; a longer one goes alone
LONG_WORD = 256
# parts that a worker remembers
MEMORY = 500_000


def merged_counts(vocabulary: P.Pieces, parts: list[str]) -> np.ndarray:
    """Number of tokens of each part.

    All parts stand in one flat array of symbols. Each round looks up every
    neighbouring pair, takes each part's pair of lowest rank (the leftmost of
    equals) and merges all of these at once; parts without a pair leave with
    the number of symbols that survive.
    """
    points, lengths = P.letters(parts)
    out = np.zeros(len(parts), dtype=np.int64)
    if not len(points):
        return out
    symbol = vocabulary.alphabet[points].astype(np.int64)
    part = np.repeat(np.arange(len(parts)), lengths)
    # a character outside the vocabulary is its bytes and cuts the part in two
    foreign = symbol == vocabulary.size
    np.add.at(out, part[foreign], P.utf8_length(points[foreign]))
    run = part + np.cumsum(foreign)
    symbol, part, run = symbol[~foreign], part[~foreign], run[~foreign]
    starts = np.flatnonzero(np.diff(run, prepend=-1))
    sizes = np.diff(starts, append=len(run))
    for k in np.flatnonzero(sizes > LONG_WORD):
        s = starts[k]
        out[part[s]] += len(vocabulary.merge_one(symbol[s:s + sizes[k]].tolist()))
    keep = np.repeat(sizes <= LONG_WORD, sizes)
    symbol, part, run = symbol[keep], part[keep], run[keep]
    while len(symbol):
        starts = np.flatnonzero(np.diff(run, prepend=-1))
        into = np.append(vocabulary.merged(symbol[:-1], symbol[1:]), -1)
        into[np.append(starts[1:] - 1, len(symbol) - 1)] = -1  # no pair over the end of a run
        order = np.where(into >= 0, vocabulary.rank[into], P.NEVER) << 32 | np.arange(len(symbol))
        first = np.minimum.reduceat(order, starts)
        alive = first < P.NEVER << 32
        sizes = np.diff(starts, append=len(symbol))
        np.add.at(out, part[starts[~alive]], sizes[~alive])
        at = first[alive] & 0xFFFFFFFF
        symbol[at] = into[at]
        keep = np.repeat(alive, sizes)
        keep[at + 1] = False
        symbol, part, run = symbol[keep], part[keep], run[keep]
    return out


@lru_cache(maxsize=1)
def _worker_state(path: str) -> tuple[P.Pieces, dict[str, int]]:
    """Vocabulary and known parts of a worker, kept from task to task."""
    return P.load(path), {}


def count_tokens(docs: DataFrame, limit: int = 4096, tokenizer_folder: str | None = None) -> DataFrame:
    """Tokens of each whole text: ``doc_id, n_bytes, n_tokens, over_limit``.

    Counts are those of the SentencePiece library for ``piece_bpe_32k.model``
    without begin and end. Texts are cut at spaces and line feeds into parts
    that no merge crosses; each worker counts the parts it has not met with
    ``merged_counts`` and adds up the parts of each text. Texts pass in slices
    of a few megabytes, so memory does not grow with the batch.

    Null and empty texts have no bytes and no tokens. Null ids, repeated rows
    and extra columns pass as they are, the latter unread.
    """
    path = tokenizer_path("piece_bpe_32k.model", tokenizer_folder)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, known = _worker_state(path)
        for batch in slices(batches, "text", 4 << 20):
            texts = batch.column(1).to_pylist()
            parts = [P.words(t) for t in texts]
            new = list(set().union(*parts).difference(known))
            if len(known) + len(new) > MEMORY:
                known.clear()
                new = list(set().union(*parts))
            known.update(zip(new, merged_counts(vocabulary, [P.spelled(w) for w in new]).tolist()))
            n = np.array([sum(map(known.__getitem__, ws)) for ws in parts], dtype=np.int64)
            n_bytes = pc.binary_length(batch.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    source = with_python(docs).select("doc_id", text_of().alias("text"))
    return source.mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
