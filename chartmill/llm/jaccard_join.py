"""N-gram Jaccard join by partition-and-enumerate signatures, without false negatives."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartmill.llm.common import components, slices, text_of, with_python, write_table

# documents and shingles of a block within which sets are compared
BLOCK_SETS = 512
BLOCK_SHINGLES = 2_000_000
# words that a worker remembers with their hashes
MEMORY = 1_000_000
# most sets with one signature whose pairs are counted one by one; sets of a larger group are tied to its first set
PAIRED_SETS = 8
# kinds of rows beside signatures, in place of a signature, which is never negative
TIE, COPY, COUNT, PAIR = -1, -2, -3, -4
ROWS = "key bigint, a bigint, b bigint, n int"


# ---------------------------------------------------------------- sets
class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_WORDS = _Hashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``width`` words.

    Words are what ASCII blanks separate, A-Z in lower case. A text with fewer
    words has its whole sequence as one shingle, one without words none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    if len(_WORDS) > MEMORY:
        _WORDS.clear()
    width = min(width, len(words))
    out = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out = _mixed(out + hashes[k:k + len(out)])
    return np.unique(out)


# ---------------------------------------------------------------- signatures
class Bands:
    """Size bands and the partitions of each.

    Two sets whose similarity is at least ``num / den`` lie in one band or in
    neighbouring ones, and differ in at most ``k`` elements, ``k`` growing with
    the sizes. The elements are dealt to ``k + 1 + spare`` partitions by a
    hash, so the sets agree in at least ``spare + 1`` of them. A set that has
    at most ``spare`` partitions with ``weak`` elements or fewer leaves these
    out, as they say little; a set with more of them leaves none out. A
    partition that both agree in is weak for both or for none. So a linked
    pair has at least ``spare + 1`` signatures in common, less the smaller of
    the two numbers left out. Texts that merely share a passage have one or two.
    """

    def __init__(self, num: int, den: int):
        self.num, self.den, self.ends, self.plans = num, den, [1], [(1, 0, -1)]

    def band(self, size: int) -> int:
        while self.ends[-1] < size:
            self._grow()
        return int(np.searchsorted(self.ends, size))

    def plan(self, band: int) -> tuple[int, int, int]:
        """Partitions, partitions that may be left out, most elements of a weak one."""
        while len(self.ends) <= band:
            self._grow()
        return self.plans[band]

    def _grow(self) -> None:
        below = self.ends[-2] if len(self.ends) > 1 else 0
        end = max(self.ends[-1] + 1, self.ends[-1] * self.den // self.num)
        k = 2 * end * (self.den - self.num) // (self.den + self.num)
        self.ends.append(end)
        self.plans.append(self._chosen(k, below + 1))

    @staticmethod
    def _chosen(k: int, least_size: int) -> tuple[int, int, int]:
        """A quarter of spare partitions; weak is what a good half of the spare ones make room for."""
        if k == 0:
            return 1, 0, -1
        spare = -(-(k + 1) // 4)
        count, weak = k + 1 + spare, -1
        term = tail = math.exp(-least_size / count)
        while count * tail + 3 * math.sqrt(count * tail) <= max(1.0, 0.6 * spare):
            weak += 1
            term *= least_size / count / (weak + 1)
            tail += term
        return count, spare, max(weak, 0)


@lru_cache(maxsize=8)
def bands_of(num: int, den: int) -> Bands:
    return Bands(num, den)


def signatures(sets: list[np.ndarray], bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of non-empty sets, the index of the set of each, and how many of them a link has at least.

    A set has those of its own band, as the larger one of a pair, and those of
    the next, as the smaller one.
    """
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    home = np.array([bands.band(n) for n in sizes])
    found, whose, needed = [], [], []
    for step in (0, 1):
        plans = np.array([bands.plan(b) for b in home + step])
        parts, spare, weak = plans.T
        salt = _mixed((home + step).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        spread = _mixed(flat ^ salt[owner])
        place = (spread % parts[owner].astype(np.uint64)).astype(np.int64)
        # one row per set and partition, empty partitions included
        first = np.append(0, np.cumsum(parts))
        slot = first[owner] + place
        count = np.bincount(slot, minlength=first[-1])
        order = np.argsort(slot, kind="stable")
        total = np.zeros(first[-1], dtype=np.uint64)
        filled = np.flatnonzero(count)
        total[filled] = np.add.reduceat(_mixed(spread[order] + np.uint64(1)), np.append(0, np.cumsum(count[filled])[:-1]))
        owner_of = np.repeat(np.arange(len(sets)), parts)
        number = np.arange(first[-1]) - first[owner_of]
        thin = count <= weak[owner_of]
        left_out = np.add.reduceat(thin.astype(np.int64), first[:-1])
        keep = ~(thin & (left_out <= spare)[owner_of])
        mark = _mixed(total + _mixed(salt[owner_of] + number.astype(np.uint64)))
        found.append((mark[keep] >> np.uint64(1)).astype(np.int64))
        whose.append(owner_of[keep])
        needed.append((spare + 1 - np.minimum(left_out, spare))[owner_of[keep]])
    return np.concatenate(found), np.concatenate(whose), np.concatenate(needed)


# ---------------------------------------------------------------- comparison
def linked_pairs(sets: list[np.ndarray], side: np.ndarray | None, num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect whatever is connected by pairs with similarity of at least ``num / den``.

    With ``side`` only pairs of different sides count. Pairs that are already
    connected are not looked at again; sizes too far apart are passed over.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    sizes = np.array([len(sets[i]) for i in order])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    values, flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    mark = np.zeros(len(values), dtype=bool)
    label, out = np.arange(len(order)), []
    for x in range(len(order) - 1):
        stop = int(np.searchsorted(sizes, sizes[x] * den // num, side="right"))
        if stop <= x + 1:
            continue
        near = slice(x + 1, stop)
        asked = label[near] != label[x]
        if side is not None:
            asked &= side[order[near]] != side[order[x]]
        if not asked.any():
            continue
        mine = flat[starts[x]:ends[x]]
        mark[mine] = True
        shared = np.add.reduceat(mark[flat[ends[x]:ends[stop - 1]]], starts[near] - ends[x], dtype=np.int64)
        mark[mine] = False
        close = asked & (den * shared >= num * (sizes[x] + sizes[near] - shared))
        for y in (np.flatnonzero(close) + x + 1).tolist():
            if label[y] != label[x]:
                out.append((int(order[x]), int(order[y])))
                label[label == label[y]] = label[x]
    return out


# ---------------------------------------------------------------- Spark
def _rows(key: int | np.ndarray, a, b, n) -> pa.RecordBatch:
    """Rows of ``ROWS``; ``key`` may be one kind for all."""
    key = np.full(len(a), key) if np.isscalar(key) else key
    n = np.zeros(len(a)) if n is None else n
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.asarray(n, dtype=np.int32))], ["key", "a", "b", "n"])


def _signature_rows(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Signatures of sets as ``(signature, document, shared signatures a link has, 0)``, and rows of the kinds above.

    A task gives signatures for one document of each set it meets; the others
    become links right there, so a text that very many documents copy has one
    row per task and signature.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, met = bands_of(num, den), {}
        for batch in slices(batches, "text", 4 << 20):
            ids = batch.column(0)
            sets = [shingle_set(t.as_py(), width) for t in batch.column(1)]
            yield _rows(COUNT, ids, np.array([len(s) for s in sets]), None)
            own, copies = [], []
            for i, s in zip(ids.to_pylist(), sets):
                if i is None or not len(s):
                    continue
                whole = (len(s), int(s.sum()), int(_mixed(s).sum()))
                first = met.setdefault(whole, i)
                if first == i:
                    own.append((i, s))
                else:
                    copies.append((i, first))
            if copies:
                yield _rows(COPY, *np.array(copies).T, None)
            if own:
                key, whose, needed = signatures([s for _, s in own], bands)
                yield _rows(key, np.array([i for i, _ in own])[whose], needed, None)

    source = with_python(docs).select("doc_id", text_of().alias("text"))
    return source.mapInArrow(emit, ROWS)


def pairs_of_runs(key: np.ndarray, node: np.ndarray, needed: np.ndarray, most: int = PAIRED_SETS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within runs of one signature, and ties to the first set for longer runs.

    Rows are sorted by signature and document. Returns rows of first document,
    second document, shared signatures and needed ones, and rows of document,
    first document and needed signatures.
    """
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sizes = np.diff(starts, append=len(key))
    pairs = []
    for m in np.unique(sizes[(sizes > 1) & (sizes <= most)]).tolist():
        here = starts[sizes == m][:, None]
        one, two = np.triu_indices(m, 1)
        one, two = (here + one).ravel(), (here + two).ravel()
        pairs.append(np.stack([node[one], node[two], np.maximum(needed[one], needed[two])]))
    large = np.repeat(sizes > most, sizes)
    tied = np.stack([node, np.repeat(node[starts], sizes), needed])[:, large]
    if not pairs:
        return np.zeros((4, 0), dtype=np.int64), tied
    a, b, t = np.concatenate(pairs, axis=1)
    order = np.lexsort((t, b, a))
    a, b, t = a[order], b[order], t[order]
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    return np.stack([a[first], b[first], np.diff(first, append=len(a)), t[first]]), tied


def _meetings(rows: DataFrame) -> DataFrame:
    """The rows that are no signatures, pairs of sets with the number of their shared signatures, and ties of large groups."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), dtype=np.int64)  # the last signature's run, which may go on
        for batch in batches:
            key = batch.column(0).to_numpy()
            if (key < 0).any():
                yield batch.filter(pa.array(key < 0))
            sign = np.flatnonzero(key >= 0)
            if not len(sign):
                continue
            new = np.stack([key[sign], *(batch.column(c).take(pa.array(sign)).to_numpy() for c in (1, 2))])
            held = np.concatenate([held, new], axis=1)
            stop = int(np.searchsorted(held[0], held[0, -1]))
            done, held = held[:, :stop], held[:, stop:]
            if held.shape[1] > PAIRED_SETS + 1:
                # a large group goes on: of what is tied already only enough to know it is held
                yield _rows(TIE, held[1], np.full(held.shape[1], held[1, 0]), held[2])
                held = held[:, :PAIRED_SETS + 1]
            yield from told(done)
        yield from told(held)

    def told(runs: np.ndarray) -> Iterator[pa.RecordBatch]:
        if runs.shape[1]:
            pairs, tied = pairs_of_runs(*runs)
            # the needed number stands above the shared one in a single integer
            yield _rows(PAIR, pairs[0], pairs[1], np.minimum(pairs[3], 0x7FFF) << 16 | np.minimum(pairs[2], 0xFFFF))
            yield _rows(TIE, *tied)

    # rows of a kind are dealt by their document, signatures by themselves
    dealt = rows.repartition(F.when(F.col("key") >= 0, F.col("key")).otherwise(F.xxhash64("a", "b")))
    return dealt.sortWithinPartitions("key", "a").mapInArrow(meet, ROWS)


def _candidates(met: DataFrame) -> DataFrame:
    """Pairs that may be links, and ties that may stand for some.

    Of the signatures that a pair shares, those of large groups are not
    counted; there are at most as many as the set with fewer of them has. A
    pair is a candidate if the others make up for the rest of what a link
    needs. A set for which large groups alone may be enough keeps its ties to
    them. So each link is a candidate, or both its ends are tied to one set.
    """
    shared, needed = F.col("n").bitwiseAND(0xFFFF), F.shiftright("n", 16)
    pairs = met.filter(F.col("key") == PAIR).groupBy("a", "b").agg(F.sum(shared).alias("shared"), F.min(needed).alias("needed"))
    ties = met.filter(F.col("key") == TIE)
    large = write_table(ties.groupBy("a").agg(F.count("*").alias("large"), F.min("n").alias("least")), "jaccard-large")
    one, two = (large.select(F.col("a").alias(c), F.col("large").alias(f"large_{c}")) for c in ("a", "b"))
    left = F.col("needed") - F.least(F.coalesce("large_a", F.lit(0)), F.coalesce("large_b", F.lit(0)))
    near = pairs.join(one, "a", "left").join(two, "b", "left").filter(F.col("shared") >= left).select("a", "b")
    return near.unionByName(ties.select("a", "b").join(large.filter("large >= least").select("a"), "a", "left_semi").filter("a <> b").distinct())


def jaccard_components(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100, block_sets: int = BLOCK_SETS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Components of texts whose shingle sets have similarity ``num / den`` or more.

    Returns ``doc_id, n_shingles, component_id`` for every row; the component
    is the smallest id that links reach. No link is lost:

    1. Each distinct set gets its signatures (``Bands``). Pairs that share as
       many as a link has at least are candidates; sets of signatures that many
       share are tied to the first of them where those may be enough
       (``_candidates``). Both make families.
    2. The texts of families are fetched once and compared within blocks. A
       family with more than a block of different sets is compared block by
       block, so no task grows with a family.
    3. Links of blocks and copies are joined to components.

    Texts without words are linked with nothing. Null texts count as empty. A
    row without id has null as component and is linked with nothing. Rows that
    repeat an id share its component. Extra columns are not read.
    """
    met = write_table(_meetings(_signature_rows(docs, width, num, den)), "jaccard")
    counts = met.filter(F.col("key") == COUNT).select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"))
    family = components(_candidates(met), "jaccard-family").withColumnRenamed("component", "family")
    sized = family.join(counts.groupBy("doc_id").agg(F.max("n_shingles").alias("n")), F.col("node") == F.col("doc_id"))
    blocks = sized.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / block_sets, F.sum("n") / block_shingles)).cast("int").alias("blocks"))
    # a table of its own: the join with it then starts from plain exchanges, which can be split
    blocks = write_table(blocks, "jaccard-families")
    placed = write_table(sized.join(blocks, "family").select("node", "family", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")), "jaccard-blocks")
    texts = docs.select("doc_id", text_of().alias("text")).join(placed.hint("merge"), F.col("doc_id") == F.col("node")).select("family", "blocks", "block", "node", "text")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = texts.withColumn("other", other).select("family", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "node", "text")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        sets = [shingle_set(t, width) for t in group.text]
        side = None if group.one.iloc[0] == group.two.iloc[0] else group.block.to_numpy()
        found = linked_pairs(sets, side, num, den)
        node = group.node.to_numpy()
        return pd.DataFrame({"a": node[[x for x, _ in found]], "b": node[[y for _, y in found]]}, dtype="int64")

    links = paired.groupBy("family", "one", "two").applyInPandas(compare, "a bigint, b bigint")
    copies = met.filter(F.col("key") == COPY).select("a", "b")
    joined = components(links.unionByName(copies), "jaccard-links")
    return counts.join(joined, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with all its columns; of each component the document with the smallest id stays."""
    gone = jaccard_components(docs, width, num, den).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(write_table(gone, "jaccard-gone").hint("merge"), "doc_id", "left_anti").select(*docs.columns)
