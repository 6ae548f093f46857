"""A SentencePiece BPE vocabulary as arrays, and the words its merges never leave."""

from __future__ import annotations

import heapq
import re
from functools import cached_property, lru_cache

import numpy as np

# fixed value: the mark that stands for a space in pieces
MARK = "▁"
NEVER = np.int64(1) << 30
_WORDS = re.compile(r"\n[^ \n]*| +[^ \n]*")


class Pieces:
    """Pieces, their merge ranks (0 first) and the pairs that merge into them.

    A character outside the vocabulary has the id ``size``; it merges with
    nothing and counts as its UTF-8 bytes.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(self.size)]
        plain = [i for i in range(self.size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.byte = {int(self.text[i][1:-1], 16): i for i in range(self.size) if model.is_byte(i)}
        self.ids = {self.text[i]: i for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a space after another character: words can't be encoded one by one")
        scores = np.array([model.get_score(i) for i in range(self.size)])
        # equal scores have one rank; among them the leftmost pair merges first
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        pairs = [(self.ids[p[:k]] * (self.size + 1) + self.ids[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        table = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2)
        self.pair_key, self.pair_id = table[:, 0].copy(), table[:, 1].copy()
        self.pair = dict(pairs)

    @cached_property
    def alphabet(self) -> np.ndarray:
        """Id of each code point, ``size`` if it is no piece."""
        out = np.full(0x110000, self.size, dtype=np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                out[ord(p)] = i
        return out

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Piece that each pair merges into, -1 where none."""
        key = a.astype(np.int64) * (self.size + 1) + b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_id[at], -1)

    def merge_one(self, symbols: list[int]) -> list[int]:
        """Pieces of one long word: a heap of pairs over a linked list."""
        n = len(symbols)
        left, right, heap = list(range(-1, n - 1)), [*range(1, n), -1], []

        def offer(i: int) -> None:
            if i >= 0 and (j := right[i]) >= 0 and (k := self.pair.get(symbols[i] * (self.size + 1) + symbols[j])) is not None:
                heapq.heappush(heap, (int(self.rank[k]), i, symbols[i], symbols[j], k))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, k = heapq.heappop(heap)
            j = right[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue
            symbols[i], symbols[j], right[i] = k, -1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i])
            offer(i)
        return [s for s in symbols if s >= 0]


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def words(text: str) -> list[str]:
    """Parts of a text that no merge crosses; their pieces in a row are the text's.

    A part that begins with a line feed stands for itself, any other for a
    space mark and itself; further spaces at its start are spaces.
    """
    if not text:
        return []
    spread = text.replace("\n", " \n")
    if MARK not in text and "  " not in spread and spread[0] != " " and spread[-1] != " ":
        return spread.split(" ")
    return [w if w[0] == "\n" else w[1:] for w in _WORDS.findall(" " + text.replace(MARK, " "))]


def spelled(word: str) -> str:
    """The characters that a part from ``words`` stands for."""
    return word if word[:1] == "\n" else MARK + word.replace(" ", MARK)


def letters(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all parts in a row, and the length of each part."""
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points, np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))


def utf8_length(points: np.ndarray) -> np.ndarray:
    return 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
