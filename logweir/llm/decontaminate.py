"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into passages of 64 words, 32 apart, as TF-IDF vectors over hashed words. A distributed randomised SVD
gives the corpus' own leading directions: one pass counts document frequencies and sums the passages, with random signs,
into a few random columns; a second one multiplies those with the Gram matrix of all passages, which is a power step and
gives the small projected matrix. Passages and benchmark passages are compared by cosine of their projections. Latent
space holds few of the rare words, so passages that hold enough of a benchmark passage's rarest words are candidates as
well, found through an index of those words. Candidates are confirmed by the longest common subsequence of words with the
item and with its answer, its last words, so paraphrases that keep most words in order are found too, also where it is the
rare words that changed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, mix, spans_hash, table, tidy, without_ids, written

BLOCK = 32
DIMS, RANK, OVERSAMPLE = 1 << 15, 64, 16
COLUMNS = RANK + OVERSAMPLE
#: Dimensions whose rows of a product are summed as one value.
SLICE = 64
#: Blocks that are multiplied at once, and benchmark passages whose vectors are made at once.
STEP, QUERIES = 32, 256
#: Places of candidates that are looked up at once, in a table of so many bits of address.
ROWS, SLOT_BITS = 512, 22
#: Words that a task holds before it adds them to its columns.
WAITING = 2_000_000
#: Words of a benchmark passage, and of its answer: items come without answers marked, so their last words stand for them.
ITEM_WORDS, ANSWER_WORDS = 64, 8
#: Least latent cosine of a candidate.
LATENT = 0.9
#: Of other candidates: which share of a benchmark passage's words are its rarest, but not fewer than LEAST_KEYS, and how many of those a passage has.
RAREST, LEAST_KEYS, HELD = 0.25, 4, 0.4
#: Of both: the shares of words in order that confirm them.
LCS, ANSWER = 0.6, 0.5
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in ".,;:!?"]] = True


def word_hashes(w: Words) -> np.ndarray:
    """Hashes of the words, lower-cased, without one closing mark."""
    last = _MARKS[w.data[np.maximum(w.end - 1, 0)]] if len(w.end) else np.zeros(0, bool)
    end = np.where(last & (w.end - w.start > 1), w.end - 1, w.end)
    return spans_hash(w.data, w.start, end)


def _dims(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(49)).astype(np.int64)


@cache
def one_thread() -> None:
    """BLAS uses one thread from now on in this process: a task has one core, and threads that wait for one another use up others'."""
    for path in Path(np.__file__).parents[1].glob("numpy.libs/*openblas*"):
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if f := getattr(ctypes.CDLL(str(path)), name, None):
                f(1)


def _blocks(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word of each block of 32 words of a text, with the total at the end, and the blocks' text numbers."""
    n = -(-w.counts // BLOCK)
    doc = np.repeat(np.arange(len(n)), n)
    start = w.first[doc] + BLOCK * (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n))
    return np.append(start, len(w.hashes)), doc


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, with one bit for each place of a."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each task's signed sums of passages in COLUMNS columns, with their document frequencies as a last one, by row; the number of passages as a last slice."""
    total, n = np.zeros(DIMS * (COLUMNS + 1)), 0
    cells: list[np.ndarray] = []
    signs: list[np.ndarray] = []

    def add() -> None:
        total[:] += np.bincount(np.concatenate(cells), np.concatenate(signs), len(total))
        cells.clear()
        signs.clear()

    for b in batches:
        for _, _, w in chunks(b.column(0), lower=True):
            start, _ = _blocks(w)
            if len(start) < 2:
                continue
            block = np.repeat(np.arange(len(start) - 1), np.diff(start))
            n += len(start) - 1
            hashes = word_hashes(w)
            dims = _dims(hashes)
            pairs = np.sort(block * DIMS + dims)
            seen = pairs[np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)]] % DIMS
            # A passage's column and sign come from its words, so that a task that runs again adds the same.
            draw = mix(np.add.reduceat(hashes, start[:-1]))
            column, sign = (draw >> np.uint64(8)) % np.uint64(COLUMNS), np.where(draw & np.uint64(1), 1.0, -1.0)
            cells += [dims * (COLUMNS + 1) + column.astype(np.int64)[block], seen * (COLUMNS + 1) + COLUMNS]
            signs += [sign[block], np.ones(len(seen))]
            if sum(map(len, cells)) >= WAITING:
                add()
    if cells:
        add()
    yield _slices(total.reshape(DIMS, -1))
    yield pa.RecordBatch.from_pydict({"slice": pa.array([DIMS // SLICE], pa.int32()), "part": pa.array([np.float32(n).tobytes()], pa.binary())})


def _slices(total: np.ndarray) -> pa.RecordBatch:
    """The slices of a product that have any values, as bytes."""
    parts = total.astype(np.float32).reshape(DIMS // SLICE, -1)
    used = np.flatnonzero(parts.any(1))
    return pa.RecordBatch.from_pydict({"slice": pa.array(used, pa.int32()), "part": pa.array([parts[k].tobytes() for k in used], pa.binary())})


@tidy
def _sum_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, part in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            values = np.frombuffer(part.as_buffer(), np.float32)
            total[k] = total[k] + values if k in total else values.astype(float)
    yield pa.RecordBatch.from_pydict({"slice": pa.array(list(total), pa.int32()), "part": pa.array([v.astype(np.float32).tobytes() for v in total.values()], pa.binary())})


def _summed(texts: DataFrame, product, width: int) -> np.ndarray:
    """The sum over tasks of a matrix with width columns, and after its rows the value of the last slice.

    A task's matrix is dense whatever its share of the texts, so a few tasks for each core make one each.
    """
    held = texts.coalesce(3 * texts.sparkSession.sparkContext.defaultParallelism)
    kind = "slice int, part binary"
    z = np.zeros((DIMS // SLICE + 1, SLICE * width))
    for row in held.mapInArrow(tidy(product), kind).repartition(F.col("slice")).mapInArrow(_sum_slices, kind).toArrow().to_pylist():
        part = np.frombuffer(row["part"], np.float32)
        z[row["slice"], : len(part)] = part
    return z


def statistics(texts: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums of passages in random columns, document frequencies, and the number of passages."""
    z = _summed(texts, _sketch, COLUMNS + 1)
    rows = z[:-1].reshape(DIMS, -1)
    return rows[:, :-1], rows[:, -1], int(z[-1, 0])


def directions(texts: DataFrame, idf: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The leading right singular directions of the texts' passages, RANK columns at most: the passages alone decide them."""
    basis, _ = np.linalg.qr(sums * idf[:, None])
    z = _summed(texts, _gram(idf, basis), COLUMNS)[:-1].reshape(DIMS, -1)
    inner = basis.T @ z
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    best = np.argsort(-values)[:RANK]
    return np.linalg.qr(z @ turn[:, best[values[best] > 1e-6 * max(values[best[0]], 1e-12)]])[0]


def _gram(idf: np.ndarray, omega: np.ndarray):
    """Each task's part of the product of the passages' Gram matrix with omega, by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        squares = (idf**2).astype(np.float32)
        loaded = (omega * idf[:, None]).astype(np.float32)
        total = np.zeros((DIMS, omega.shape[1]), np.float32)
        for b in batches:
            for _, _, w in chunks(b.column(0), lower=True):
                start, doc = _blocks(w)
                dims = _dims(word_hashes(w))
                for at in range(0, len(doc), STEP):
                    used, x = _matrix(dims, start[at : at + STEP + 1])
                    y = x @ loaded[used]
                    y /= (x @ squares[used])[:, None]  # rows of unit length, on both sides
                    total[used] += x.T @ y
        yield _slices(total * idf[:, None])

    return run


def _matrix(dims: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The dimensions that some blocks use, in order, and how often each block has each of them; start: the blocks' first words, with the end."""
    words = dims[start[0] : start[-1]]
    seen = np.zeros(DIMS, bool)
    seen[words] = True
    used, place = np.flatnonzero(seen), np.cumsum(seen) - 1
    n = len(start) - 1
    cell = np.repeat(np.arange(n), np.diff(start)) * len(used) + place[words]
    return used, np.bincount(cell, minlength=n * len(used)).reshape(n, len(used)).astype(np.float32)


class Items:
    """Benchmark passages: their items, and their words' hashes in a row."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        ids: list[int] = []
        words: list[np.ndarray] = []
        for lo, hi, w in chunks(pa.array([t for _, t in rows], pa.string()), lower=True):
            hashes = word_hashes(w)
            for i in range(lo, hi):
                own = hashes[w.first[i - lo] : w.first[i - lo + 1]]
                for part in np.array_split(own, max(1, -(-len(own) // ITEM_WORDS))):
                    if len(part):
                        ids.append(rows[i][0])
                        words.append(part)
        self.ids = np.array(ids, np.int64)
        self.first = np.cumsum([0] + [len(x) for x in words])
        self.hashes = np.concatenate(words) if words else np.zeros(0, np.uint64)

    def words(self, k: int) -> list[int]:
        return self.hashes[self.first[k] : self.first[k + 1]].tolist()

    def vectors(self, idf: np.ndarray, lo: int, hi: int) -> np.ndarray:
        q = np.zeros((hi - lo, DIMS), np.float32)
        own = self.hashes[self.first[lo] : self.first[hi]]
        np.add.at(q, (np.repeat(np.arange(hi - lo), np.diff(self.first[lo : hi + 1])), _dims(own)), 1)
        return q * idf

    def project(self, idf: np.ndarray, corpus: np.ndarray) -> np.ndarray:
        """Unit vectors in latent space, one in each column."""
        parts = [self.vectors(idf, lo, min(lo + QUERIES, len(self.ids))) @ corpus for lo in range(0, len(self.ids), QUERIES)]
        latent = np.vstack(parts)
        return (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)).T.astype(np.float32)

    def index(self, df: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rarest words of the passages in order, the passage of each, and how many of them a candidate needs."""
        keys, owners, needed = [], [], np.zeros(len(self.ids), np.int64)
        for k in range(len(self.ids)):
            own = np.unique(self.hashes[self.first[k] : self.first[k + 1]])
            rare = own[np.argsort(df[_dims(own)], kind="stable")][: max(LEAST_KEYS, round(RAREST * len(own)))]
            keys.append(rare)
            owners.append(np.full(len(rare), k))
            needed[k] = max(1, int(np.ceil(HELD * len(rare))))
        key, owner = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(key, kind="stable")
        return key[order], owner[order], needed


def _holding(hashes: np.ndarray, block: np.ndarray, doc: np.ndarray, index: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Passages (by their first block) and the benchmark passages of which they hold enough rare words."""
    key, owner, needed, maybe = index
    at = np.flatnonzero(maybe[_dims(hashes)])
    lo = np.searchsorted(key, hashes[at])
    n = np.searchsorted(key, hashes[at], "right") - lo
    posting = _ranges(lo, n)
    of = np.repeat(block[at], n)
    before = np.flatnonzero(of > 0)
    before = before[doc[of[before] - 1] == doc[of[before]]]  # a block is the second half of the passage before
    seen = np.unique(np.concatenate([of, of[before] - 1]) * len(key) + np.concatenate([posting, posting[before]]))
    pairs, held = np.unique(seen // len(key) * len(needed) + owner[seen % len(key)], return_counts=True)
    pairs = pairs[held >= needed[pairs % len(needed)]]
    return pairs // len(needed), pairs % len(needed)


def _slots(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """A place in a table of SLOTS for each word of a row."""
    return ((hashes ^ row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD1342543DE82EF95) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo, lo + 1, ... of each range in turn."""
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def _sharing(items: Items, hashes: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether words lo to hi can hold LCS of the words of benchmark passage k, in any order, for each candidate; candidates of one place follow one another."""
    row = np.cumsum(np.diff(lo, prepend=-1) != 0) - 1
    out = np.zeros(len(k), bool)
    for at in range(0, int(row[-1]) + 1 if len(row) else 0, ROWS):
        f, t = np.searchsorted(row, [at, at + ROWS])
        heads = f + np.flatnonzero(np.diff(row[f:t], prepend=-1))
        table = np.zeros(1 << SLOT_BITS, bool)
        n = hi[heads] - lo[heads]
        table[_slots(hashes[_ranges(lo[heads], n)], np.repeat(row[heads], n))] = True
        first = items.first[k[f:t]]
        m = items.first[k[f:t] + 1] - first
        there = table[_slots(items.hashes[_ranges(first, m)], np.repeat(row[f:t], m))]
        out[f:t] = np.add.reduceat(there, np.cumsum(m) - m, dtype=np.int64) >= LCS * m
    return out


def _search(items: Items, idf: np.ndarray, df: np.ndarray, corpus: np.ndarray):
    """Hits of the benchmark passages; corpus: the corpus' leading directions."""
    latent = items.project(idf, corpus)
    loaded = (corpus * idf[:, None]).astype(np.float32)
    key, owner, needed = items.index(df)
    maybe = np.zeros(DIMS, bool)
    maybe[_dims(key)] = True
    index = key, owner, needed, maybe

    def candidates(w: Words, hashes: np.ndarray, start: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """Text, word range and benchmark passage of each candidate, with the latent cosine."""
        n, dims = len(doc), _dims(hashes)
        projected = np.empty((n, latent.shape[0]), np.float32)
        by_word = _holding(hashes, np.repeat(np.arange(n), np.diff(start)), doc, index)
        codes = [by_word[0] * len(items.ids) + by_word[1]]
        for at in range(0, n, STEP):  # each block with the next one of its text
            to = min(n, at + STEP)
            more = min(n, to + 1)
            used, x = _matrix(dims, start[at : more + 1])
            y = x @ loaded[used]
            part = projected[at:to]
            part[:] = y[: to - at]
            same = doc[at + 1 : more] == doc[at : more - 1]
            part[: len(same)][same] += y[1:][same]
            part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
            i, k = np.nonzero(part @ latent >= LATENT)
            codes.append((at + i) * len(items.ids) + k)
        i, k = np.divmod(np.unique(np.concatenate(codes)), len(items.ids))
        lo, hi = np.maximum(w.first[doc[i]], start[i] - BLOCK), np.minimum(w.first[doc[i] + 1], start[i] + 3 * BLOCK)
        sharing = _sharing(items, hashes, lo, hi, k)
        i, k = i[sharing], k[sharing]
        cosine = (projected[i] * latent.T[k]).sum(1)
        return zip(doc[i].tolist(), lo[sharing].tolist(), hi[sharing].tolist(), k.tolist(), cosine.tolist(), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for b in batches:
            ids = b.column(0).to_pylist()
            out: list[tuple] = []
            for first, _, w in chunks(b.column(1), lower=True):
                start, doc = _blocks(w)
                if not len(doc):
                    continue
                hashes = word_hashes(w)
                for d, lo, hi, k, cosine in candidates(w, hashes, start, doc):
                    words, near = items.words(k), hashes[lo:hi].tolist()
                    answer = words[-ANSWER_WORDS:]
                    share, ends = lcs(words, near) / len(words), lcs(answer, near) / len(answer)
                    if share >= LCS and ends >= ANSWER:
                        out.append((ids[first + d], int(items.ids[k]), cosine, share, ends))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (b.column(0).type, pa.int64(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "cosine", "lcs_share", "answer_share"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and benchmark item that it holds: doc_id, item_id and the best cosine, lcs_share and answer_share.

    An item counts as held when some passage has a latent cosine of LATENT with it, or HELD of its rarest words, and LCS of
    its words in order and ANSWER of its answer's; cosine is the latent one. Items longer than ITEM_WORDS are looked for in
    parts. Null and empty texts and items hold nothing; rows that repeat an id count once; an empty table on either side
    gives an empty table; other columns are ignored. The benchmark is the query set: it comes to the driver and goes to
    every task; all its items are searched for in one pass.
    """
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, cosine double, lcs_share double, answer_share double"
    rows = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("i"), F.col(f"`{item_text_col}`").alias("t")).where("t IS NOT NULL").distinct().orderBy("i", "t").collect()
    items = Items([tuple(r) for r in rows])
    texts = docs.select("text")
    sums, df, total = statistics(texts)
    if not len(items.ids) or not total:
        return docs.sparkSession.createDataFrame([], schema)
    idf = np.log1p(total / (1 + df))
    found = docs.mapInArrow(tidy(_search(items, idf, df, directions(texts, idf, sums))), schema)
    return found.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("lcs_share").alias("lcs_share"), F.max("answer_share").alias("answer_share"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **columns: str) -> DataFrame:
    """docs, all columns, without the rows whose id find_leaks gives; rows without an id stay."""
    return without_ids(docs, written(find_leaks(docs, benchmark, id_col, **columns).select("doc_id").distinct(), "leaks"), id_col)


def op1_latent_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
