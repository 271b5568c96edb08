"""What the operators share: the shared work folder, written tables and vectorised word hashing.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``; null texts count as empty.
"""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.sources.store import shared_dir

#: Bytes of text that are looked at as one chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Bytes that are hashed at once, whatever the chunk.
SLICE_BYTES = 128 << 10
#: Rows whose texts are Python's strings at once.
FEW_ROWS = 256
#: What an operator's tasks keep in their worker for later ones, by its module.
KEPT: dict[str, dict] = {}

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read again: lineage ends here, and lost executors cost nothing before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes written tables that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs
        for file in df.inputFiles()[:1]:
            folder = hadoop.Path(file).getParent()
            folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def give_back() -> None:
    """Freed memory goes back to the system, as far as the allocators can tell."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):  # only glibc has it
        trim(0)


def forget_others(module: str) -> None:
    """Lets go what the other operators keep."""
    for owner, held in KEPT.items():
        if owner != module:
            held.clear()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, a task's pass over its batches, that gives back what it has freed, and before it what other operators' tasks
    have kept: a worker outlives its tasks, and would hold the most that one of them took while later stages need it
    elsewhere on the executor."""

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(run.__module__)
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of FEW_ROWS."""
    for b in batches:
        for at in range(0, b.num_rows, FEW_ROWS):
            yield b.slice(at, FEW_ROWS)


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """docs, all columns, without the rows whose id is in ids, a table of one column; rows without an id stay."""
    name = fresh_name(docs, "gone_id")
    return docs.join(ids.toDF(name), F.col(f"`{id_col}`") == F.col(f"`{name}`"), "left_anti")


def texts(batch: pa.RecordBatch, col: int | str) -> list[str]:
    """The column's texts, nulls as empty ones."""
    return [x or "" for x in batch.column(col).to_pylist()]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _places(start: int, n: int) -> np.ndarray:
    """A multiplier for each place in a word: pseudo-random, so that no pattern of letters cancels out."""
    return mix(np.arange(start + 1, start + n + 1, dtype=_U) * _GOLD) | _U(1)


def _letters(data: np.ndarray) -> np.ndarray:
    """A pseudo-random number for each letter."""
    return mix((data.astype(_U) + _U(1)) * _U(0xD1342543DE82EF95))


_LETTER = _letters(np.arange(256))
_PLACE = _places(0, SLICE_BYTES)


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end], bytes or code points, for each of the spans, which follow one another without overlap.

    The sum over its letters of a number for the letter times a number for its place. Memory is bounded by SLICE_BYTES,
    whatever the length of the texts and words.
    """
    out = np.zeros(len(start), _U)
    letters = _LETTER.__getitem__ if data.dtype == np.uint8 else _letters
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + SLICE_BYTES, "right")))
        lo, hi = int(start[i]), int(end[j - 1])
        if hi - lo > SLICE_BYTES:
            for at in range(lo, hi, SLICE_BYTES):
                part = data[at : min(hi, at + SLICE_BYTES)]
                out[i : i + 1] += (letters(part) * _places(at - lo, len(part))).sum()
        else:
            s, e = start[i:j] - lo, end[i:j] - lo
            place = np.arange(hi - lo, dtype=np.int32)
            place -= np.repeat(s.astype(np.int32), np.diff(s, append=hi - lo))
            sums = np.zeros(hi - lo + 1, _U)
            values = letters(data[lo:hi])
            values *= _PLACE[place]
            np.cumsum(values, out=sums[1:])
            out[i:j] = sums[e] - sums[s]
        i = j
    return mix(out + (end - start).astype(_U) * _GOLD)


def windows_hash(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each width hashes in a row, put together from windows whose widths are powers of two."""
    n = len(hashes) - width + 1
    if n <= 0:
        return hashes[:0]
    out, done, size, part = None, 0, 1, hashes
    while True:
        if width & size:
            piece = part[done : done + n]
            out = piece if out is None else mix(out * _U(0xC2B2AE3D27D4EB4F) + piece)
            done += size
        if 2 * size > width:
            return mix(out ^ _U(width))
        part = mix(part[:-size] * _U(0xD1342543DE82EF95) + part[size:])
        size *= 2


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """Word hashes of a chunk of texts.

    hashes: of every word; first: index of each text's first word, with the total at the end;
    start, end: byte places in data; doc: text number of each word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> None:
        self.data = data = _LOWER[data] if lower else data
        n = len(data)
        inside = np.zeros(n + 2, bool)
        np.logical_not(_SPACE[data], out=inside[1 : n + 1])
        begins = inside[1 : n + 1] & ~inside[:n]
        heads = offsets[:-1][offsets[:-1] < n]
        cut = heads[inside[heads + 1]]  # a text that starts with a word
        begins[cut] = True
        ends = inside[1 : n + 1] & ~inside[2 : n + 2]
        tails = offsets[1:][offsets[1:] > 0]
        ends[tails[inside[tails]] - 1] = True
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hashes = spans_hash(data, self.start, self.end)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Word index and text number of each window of so many words within one text."""
        n = np.maximum(self.counts - width + 1, 0)
        doc = np.repeat(np.arange(len(n)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.first[doc]
        return at, doc

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits, as two arrays, for the word sequence of each text."""
        n = self.counts
        place = (np.arange(len(self.hashes)) - np.repeat(self.first[:-1], n)).astype(_U) * _GOLD
        out = []
        for salt in (0x2545F4914F6CDD1D, 0x8CB92BA72F3D8DD7):
            sums = np.zeros(len(self.hashes) + 1, _U)
            np.cumsum(mix(mix(self.hashes ^ _U(salt)) + place), out=sums[1:])
            out.append(mix(sums[self.first[1:]] - sums[self.first[:-1]] + n.astype(_U) * _GOLD))
        return out[0], out[1]


def chunks(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """First and last row (exclusive) and Words of each run of rows of about CHUNK_BYTES."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        lo, hi = offsets[row], offsets[to]
        yield row, to, Words(data[lo:hi], offsets[row : to + 1] - lo, lower)
        row = to


def signed(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a).view(np.int64)
