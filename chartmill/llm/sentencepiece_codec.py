"""SentencePiece encoding by suffix-array matching, and decoding."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartmill.llm import pieces as P
from chartmill.llm.common import slices, text_of, tokenizer_path, with_python

# parts that a worker remembers with their ids
MEMORY = 400_000
# parts that are indexed together: their edges take about 2 kB a part
BATCH = 25_000
# a longer part is relaxed edge by edge instead of in step with the others
LONG_WORD = 1024
# letters of a piece that one 64-bit sort key holds
PACKED = 4


class Encoder:
    """Encodes many distinct parts of texts at once.

    1. Index: the parts stand in one array; their suffixes are sorted by as
       many letters as the longest piece has.
    2. Match: every piece is searched in the suffix array by bisection, all
       pieces together; its range holds all its occurrences, the edges.
    3. Relax: edges are sorted by the place where they end. The tokens of a
       prefix have one possible last token: the edge whose start has been
       reached and that follows the last token there without a merge that
       byte-pair encoding would have made across. A part's ids are read
       backwards from its end.
    """

    def __init__(self, path: str):
        self.pieces = P.load(path)
        v = self.pieces
        self.foreign = v.size
        # which pieces a merge sequence can end in, and the pair merged last
        self.head, self.tail = np.full((2, v.size + 1), -1, dtype=np.int64)
        usable = []
        for p, i in v.ids.items():
            if len(p) == 1:
                usable.append(i)
                continue
            symbols = [v.ids.get(c, -1) for c in p]
            if min(symbols) < 0:
                continue
            best = self._last_pair(symbols, i)
            if best:
                self.head[i], self.tail[i] = best
                usable.append(i)
        self.made = np.append(np.where(self.head[:-1] >= 0, v.rank, -1), -1)
        self.length = np.array([len(p) for p in v.text] + [1])
        usable.sort()
        self.depth = -(-max(len(v.text[i]) for i in usable) // PACKED) * PACKED
        letters = sorted({ord(c) for i in usable for c in v.text[i]})
        # letters by their rank from 1; 0 ends a part or is no letter
        self.letter = np.zeros(0x110000, dtype=np.uint64)
        self.letter[letters] = np.arange(1, len(letters) + 1, dtype=np.uint64)
        if len(letters) >= 1 << 16:
            raise ValueError("more letters than a sort key holds")
        self.sought = np.array(usable)
        low, high = np.zeros((2, len(usable), self.depth), dtype=np.uint64)
        high[:] = 0xFFFF
        for row, i in enumerate(usable):
            codes = self.letter[[ord(c) for c in v.text[i]]]
            low[row, :len(codes)] = high[row, :len(codes)] = codes
        self.low, self.high = self._packed(low), self._packed(high)

    def _last_pair(self, symbols: list[int], whole: int) -> tuple[int, int] | None:
        """The two pieces whose merge ends in ``whole``, None if merging its letters ends elsewhere."""
        v, last = self.pieces, None
        while len(symbols) > 1:
            ranked = [(v.rank[k], at, k) for at in range(len(symbols) - 1) if (k := v.pair.get(symbols[at] * (v.size + 1) + symbols[at + 1])) is not None]
            if not ranked:
                return None
            _, at, k = min(ranked)
            last = symbols[at], symbols[at + 1]
            symbols = [*symbols[:at], k, *symbols[at + 2:]]
        return last if symbols == [whole] else None

    @staticmethod
    def _packed(codes: np.ndarray) -> list[np.ndarray]:
        """Columns of letters, ``PACKED`` to a key."""
        keys = []
        for c in range(0, codes.shape[1], PACKED):
            key = np.zeros(len(codes), dtype=np.uint64)
            for k in range(PACKED):
                key = key << np.uint64(16) | codes[:, c + k]
            keys.append(key)
        return keys

    def suffixes(self, codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Suffix array by ``depth`` letters, and the sort keys in its order."""
        padded = np.concatenate([codes, np.zeros(self.depth, dtype=np.uint64)])
        n, first = len(codes), np.zeros(len(codes), dtype=np.uint64)
        for k in range(PACKED):
            first = first << np.uint64(16) | padded[k:k + n]
        # a suffix ends with its part: letters behind a 0 don't count
        for k in range(1, PACKED):
            ended = (first >> np.uint64(16 * (PACKED - k)) & np.uint64(0xFFFF)) == 0
            first[ended] &= ~np.uint64((1 << 16 * (PACKED - k)) - 1)
        keys = [first]
        for c in range(PACKED, self.depth, PACKED):
            key = np.append(first[c:], np.zeros(min(c, n), dtype=np.uint64))
            keys.append(np.where((keys[-1] & np.uint64(0xFFFF)) == 0, np.uint64(0), key))
        order = np.lexsort(keys[::-1])
        return order, [k[order] for k in keys]

    @staticmethod
    def _bisect(keys: list[np.ndarray], bound: list[np.ndarray], after: bool) -> np.ndarray:
        """First place in the suffix array not below (``after``: above) each bound."""
        low, high = np.zeros(len(bound[0]), dtype=np.int64), np.full(len(bound[0]), len(keys[0]), dtype=np.int64)
        while (open_ := low < high).any():
            mid = np.where(open_, (low + high) // 2, 0)
            below, equal = np.zeros(len(mid), dtype=bool), np.ones(len(mid), dtype=bool)
            for k, b in zip(keys, bound):
                at = k[mid]
                below |= equal & (at < b)
                equal &= at == b
            right = open_ & (below | equal if after else below)
            low, high = np.where(right, mid + 1, low), np.where(open_ & ~right, mid, high)
        return low

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves token ``b`` behind token ``a`` as they are.

        The merges of both are taken back, latest first. Whatever stands at
        the border at that time must not have had an earlier merge of its own.
        """
        v = self.pieces
        good = np.ones(len(a), dtype=bool)
        own = np.flatnonzero((a != self.foreign) & (b != self.foreign))
        a, b, limit = a[own].copy(), b[own].copy(), np.full(len(own), P.NEVER)
        strict = np.ones(len(own), dtype=bool)
        while len(own):
            across = v.merged(a, b)
            rank = np.where(across >= 0, v.rank[across], P.NEVER)
            # of equal ranks the leftmost pair merges first
            clash = (across >= 0) & np.where(strict, rank < limit, rank <= limit)
            good[own[clash]] = False
            # of equal ranks the merge further right was the later one
            undo_b = self.made[b] >= self.made[a]
            done = clash | ((self.made[a] < 0) & (self.made[b] < 0))
            limit = np.where(undo_b, self.made[b], self.made[a])
            strict = ~undo_b
            a, b = np.where(undo_b, a, self.tail[a]), np.where(undo_b, self.head[b], b)
            own, a, b, limit, strict = own[~done], a[~done], b[~done], limit[~done], strict[~done]
        return good

    def encode(self, parts: list[str]) -> list[bytes]:
        """Ids of each part, as little-endian 32-bit numbers in a row."""
        v = self.pieces
        points, lengths = P.letters(parts)
        codes = self.letter[points]
        # a 0 between parts keeps matches within them
        part = np.repeat(np.arange(len(parts)), lengths)
        place = np.arange(len(points)) + part
        joined = np.zeros(len(points) + len(parts), dtype=np.uint64)
        joined[place] = codes
        order, keys = self.suffixes(joined)
        low, high = self._bisect(keys, self.low, False), self._bisect(keys, self.high, True)
        times = high - low
        at = np.repeat(low - np.append(0, np.cumsum(times)[:-1]), times) + np.arange(times.sum())
        start, token = order[at], np.repeat(self.sought, times)
        strange = place[codes == 0]
        start, token = np.append(start, strange), np.append(token, np.full(len(strange), self.foreign))
        end = start + self.length[token]
        # places within their part: parts of all lengths advance together
        first = np.append(0, np.cumsum(lengths + 1)[:-1])
        owner = np.zeros(len(joined), dtype=np.int64)
        owner[place] = part
        step = end - first[owner[start]]
        alone = lengths[owner[start]] > LONG_WORD
        last = np.full(len(joined) + 1, -1, dtype=np.int64)
        self._relax(start[~alone], end[~alone], token[~alone], step[~alone], first, last)
        self._relax_alone(start[alone], end[alone], token[alone], set(first.tolist()), last)
        return self._read_back(first, lengths, last, points, place, owner)

    def _relax(self, start, end, token, step, first, last) -> None:
        order = np.argsort(step, kind="stable")
        start, end, token, step = start[order], end[order], token[order], step[order]
        begins = np.zeros(len(last), dtype=bool)
        begins[first] = True
        bounds = np.flatnonzero(np.diff(step, prepend=-1, append=-1))
        for k in range(len(bounds) - 1):
            s = slice(bounds[k], bounds[k + 1])
            opening, before = begins[start[s]], last[start[s]]
            fits = opening.copy()
            ask = np.flatnonzero(~opening & (before >= 0))
            if len(ask):
                pair, back = np.unique(before[ask] * (self.foreign + 1) + token[s][ask], return_inverse=True)
                fits[ask] = self.follows(pair // (self.foreign + 1), pair % (self.foreign + 1))[back]
            last[end[s][fits]] = token[s][fits]

    def _relax_alone(self, start, end, token, begins, last) -> None:
        known: dict[tuple[int, int], bool] = {}
        order = np.argsort(end, kind="stable")
        for s, e, t in zip(start[order].tolist(), end[order].tolist(), token[order].tolist()):
            b = int(last[s])
            if s in begins:
                last[e] = t
            elif b >= 0:
                if (b, t) not in known:
                    known[b, t] = bool(self.follows(np.array([b]), np.array([t]))[0])
                if known[b, t]:
                    last[e] = t

    def _read_back(self, first, lengths, last, points, place, owner) -> list[bytes]:
        v = self.pieces
        at, parts, found = first + lengths, np.arange(len(first)), []
        live = lengths > 0
        while live.any():
            at, parts = at[live], parts[live]
            token = last[at]
            at = at - self.length[token]
            found.append((parts, at, token))
            live = at > first[parts]
        if not found:
            return [b""] * len(first)
        parts, at, token = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(at, kind="stable")
        parts, at, token = parts[order], at[order], token[order]
        strange = token == self.foreign
        if strange.any():
            # a character outside the vocabulary becomes its bytes
            point = np.zeros(len(last), dtype=np.uint32)
            point[place] = points
            spelt = [[v.byte[b] for b in chr(c).encode("utf-8", "surrogatepass")] for c in point[at[strange]].tolist()]
            times = np.ones(len(token), dtype=np.int64)
            times[strange] = [len(x) for x in spelt]
            parts, token, strange = np.repeat(parts, times), np.repeat(token, times), np.repeat(strange, times)
            token[strange] = np.concatenate([np.array(x) for x in spelt])
        raw, ends = token.astype("<u4").tobytes(), 4 * np.cumsum(np.bincount(parts, minlength=len(first)))
        return [raw[e - 4 * n:e] for e, n in zip(ends.tolist(), np.bincount(parts, minlength=len(first)).tolist())]


@lru_cache(maxsize=1)
def _worker_state(path: str) -> tuple[Encoder, dict[str, bytes]]:
    """Encoder and known parts of a worker, kept from task to task."""
    return Encoder(path), {}


def piece_bytes(pieces: P.Pieces) -> list[bytes]:
    """What each id stands for; control ids stand for nothing."""
    value = {i: bytes([b]) for b, i in pieces.byte.items()}
    return [value.get(i, p.replace(P.MARK, " ").encode() if p in pieces.ids else b"") for i, p in enumerate(pieces.text)]


class Decoder:
    """Decodes the id lists of many texts by one lookup in a table of spellings.

    The bytes of all tokens in a row are the texts in a row, so a text begins
    where its first token does. A first token is looked up without its leading
    blank. Only texts with byte pieces can be other than UTF-8.
    """

    def __init__(self, pieces: P.Pieces):
        spelling = piece_bytes(pieces)
        self.size = len(spelling)
        # each piece, and behind them each piece as the first of a text
        self.spelling = pa.array(spelling + [s.removeprefix(b" ") for s in spelling], pa.binary())
        self.silent = np.array([not s for s in spelling])
        self.raw = np.zeros(self.size, dtype=bool)
        self.raw[list(pieces.byte.values())] = True

    def decode(self, ids: pa.ListArray) -> pa.StringArray:
        """The texts of ``ids``, null lists as empty ones."""
        offsets = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))).astype(np.int64)
        flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        # control ids stand for nothing, so the token behind them may be the first
        said = ~self.silent[flat]
        if not said.all():
            offsets = np.append(0, np.cumsum(said))[offsets]
            flat = flat[said]
        looked = flat.copy()
        first = offsets[:-1][np.diff(offsets) > 0]
        looked[first] += self.size
        found = self.spelling.take(pa.array(looked))
        starts = np.frombuffer(found.buffers()[1], dtype=np.int32)[:len(found) + 1][offsets] if len(found) else np.zeros(len(offsets), dtype=np.int32)
        data = found.buffers()[2] if len(found) else pa.py_buffer(b"")
        texts = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(starts, dtype=np.int32)), data])
        doubtful = np.flatnonzero(np.diff(np.append(0, np.cumsum(self.raw[flat]))[offsets]))
        if len(doubtful):
            mended = [texts[k].as_py().decode("utf-8", "replace").encode() for k in doubtful.tolist()]
            mask = np.zeros(len(texts), dtype=bool)
            mask[doubtful] = True
            texts = pc.replace_with_mask(texts, pa.array(mask), pa.array(mended, pa.binary()))
        return pa.Array.from_buffers(pa.string(), len(texts), texts.buffers(), offset=texts.offset)


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, pa.Array, pa.Array]]:
    """Slices of rows ``(doc_id, text)`` with the ids and the number of ids of each text."""
    encoder, known = _worker_state(path)
    for batch in slices(batches, "text", 6 << 20):
        parts = [P.words(t) for t in batch.column(1).to_pylist()]
        new = list(set().union(*parts).difference(known))
        if len(known) + len(new) > MEMORY:
            known.clear()
            new = list(set().union(*parts))
        for k in range(0, len(new), BATCH):
            some = new[k:k + BATCH]
            known.update(zip(some, encoder.encode([P.spelled(w) for w in some])))
        rows = [b"".join(map(known.__getitem__, ws)) for ws in parts]
        n = np.array([len(r) // 4 for r in rows], dtype=np.int64)
        flat = np.frombuffer(b"".join(rows), dtype="<i4")
        yield batch, pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(flat)), pa.array(n)


def encode_texts(docs: DataFrame, tokenizer_folder: str | None = None) -> DataFrame:
    """Ids of each whole text: ``doc_id, ids, n_tokens``.

    The ids are those of the SentencePiece library for ``piece_bpe_32k.model``
    without begin and end. Each worker indexes the parts of a slice of texts
    that it has not met (``Encoder``) and joins the known ids of each text.

    Null and empty texts have no ids. Null ids of documents and repeated rows
    pass as they are; extra columns are not read.
    """
    path = tokenizer_path("piece_bpe_32k.model", tokenizer_folder)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, n in _encoded(batches, path):
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, n], ["doc_id", "ids", "n_tokens"])

    source = with_python(docs).select("doc_id", text_of().alias("text"))
    return source.mapInArrow(encode, "doc_id bigint, ids array<int>, n_tokens bigint")


def decode_ids(encoded: DataFrame, tokenizer_folder: str | None = None) -> DataFrame:
    """Texts of ``encoded(doc_id, ids)``: ``doc_id, text``, as the library decodes them.

    Null or no ids give an empty text; control ids give nothing; bytes that
    are no UTF-8 become the replacement character.
    """
    path = tokenizer_path("piece_bpe_32k.model", tokenizer_folder)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(P.load(path))
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), decoder.decode(part.column(1))], ["doc_id", "text"])

    return with_python(encoded).select("doc_id", "ids").mapInArrow(decode, "doc_id bigint, text string")


def round_trips(docs: DataFrame, tokenizer_folder: str | None = None) -> DataFrame:
    """Each whole text encoded and decoded again: ``doc_id, n_tokens, ids, decoded_sha256, round_trip``.

    ``encode_texts`` and ``decode_ids`` in one pass, so that a worker keeps one
    encoder and ids cross to Python once. ``round_trip`` says whether the
    decoded text is the text, null counting as empty; a text with the mark of
    a blank is not, for it decodes to the blank.
    """
    path = tokenizer_path("piece_bpe_32k.model", tokenizer_folder)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(P.load(path))
        for batch, ids, n in _encoded(batches, path):
            texts = decoder.decode(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), n, ids, texts, pc.equal(texts, batch.column(1))], ["doc_id", "n_tokens", "ids", "decoded", "round_trip"])

    source = with_python(docs).select("doc_id", text_of().alias("text"))
    out = source.mapInArrow(both, "doc_id bigint, n_tokens bigint, ids array<int>, decoded string, round_trip boolean")
    return out.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"), "round_trip")
