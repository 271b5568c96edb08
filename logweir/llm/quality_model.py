"""A quality classifier: a generalised additive model with pairwise interactions.

Texts become a few measures, measures become bins. Shallow trees over one measure's bins are boosted in turn, each
adding its leaves to that measure's lookup table; then the pairs with the most left to explain get tables of their own.
A score is the sum of table entries at a text's bins, through the logistic function.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, table, windows_hash, written
from .toxicity import remainder

MEASURES = ("log_words", "word_length", "symbols", "bars", "exclamations", "capitals", "digits", "other_marks", "sentence_ends", "non_ascii", "repeated_lines", "repeated_phrases", "distinct_words", "words_a_line", "capitalised")
BINS, PAIR_BINS, PAIRS = 32, 8, 6
#: Labelled texts, at most about, that the model is fitted on.
TRAINING_ROWS = 20_000
THRESHOLD = 0.3
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123)]] = True
_LETTERS[128:] = True
_MARKS = np.zeros(256, bool)
_MARKS[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "#*$%&|<>!.?,"]] = True


def measures(w: Words, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of MEASURES for each text; texts without words have zeros."""
    out = np.zeros((len(offsets) - 1, len(MEASURES)), np.float32)
    first_byte = data[w.start] if len(w.start) else data[:0]
    for i in range(len(out)):
        f, t = w.first[i], w.first[i + 1]
        if f == t:
            continue
        n = t - f
        count = np.bincount(data[offsets[i] : offsets[i + 1]], minlength=256)
        chars = int((w.end[f:t] - w.start[f:t]).sum())
        hashes = w.hashes[f:t]
        distinct, seen = np.unique(hashes, return_counts=True)
        phrases = 0
        if n > 5:
            phrases = 1 - len(np.unique(windows_hash(hashes, 5))) / (n - 4)
        lines = [x for x in data[offsets[i] : offsets[i + 1]].tobytes().split(b"\n") if x.strip()]
        out[i] = (
            np.log(n), chars / n, count[[35, 42, 36, 37, 38, 60, 62]].sum() / n, count[124] / n, count[33] / n, count[65:91].sum() / chars, count[48:58].sum() / chars, count[_MARKS].sum() / n,
            count[[46, 63]].sum() / n, count[128:].sum() / chars, 1 - len(set(lines)) / len(lines), phrases, len(distinct) / n, n / len(lines), np.mean((first_byte[f:t] >= 65) & (first_byte[f:t] < 91)),
        )
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        column = b.column(2).cast(pa.large_binary()).fill_null(b"")
        for lo, hi, w in chunks(column):
            lengths = np.array([len(x.as_buffer()) for x in column.slice(lo, hi - lo)], np.int64)
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            x = measures(w, w.data, offsets)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(MEASURES)).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0).slice(lo, hi - lo), "held_out": b.column(1).slice(lo, hi - lo), "x": flat})


def _tree(gradient: np.ndarray, hessian: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values over ordered bins of the tree that splits greedily so many times over."""
    out = np.zeros(len(gradient))

    def grow(lo: int, hi: int, left: int) -> None:
        g, h = np.cumsum(gradient[lo:hi]), np.cumsum(hessian[lo:hi])
        if left and hi - lo > 1:
            gain = g[:-1] ** 2 / (h[:-1] + 1) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + 1)
            at = int(np.argmax(gain))
            if gain[at] > g[-1] ** 2 / (h[-1] + 1) + 1e-9:
                grow(lo, lo + at + 1, left - 1)
                grow(lo + at + 1, hi, left - 1)
                return
        out[lo:hi] = -g[-1] / (h[-1] + 1)

    grow(0, len(gradient), depth)
    return out


def _pair_tree(gradient: np.ndarray, hessian: np.ndarray) -> tuple[np.ndarray, float]:
    """The four leaves of the best cross of a row and a column split of a grid, and its gain."""
    g, h = gradient.cumsum(0).cumsum(1), hessian.cumsum(0).cumsum(1)
    corner = lambda c: np.stack([c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1]])
    gs, hs = corner(g), corner(h)
    gain = (gs**2 / (hs + 1)).sum(0)
    i, j = np.unravel_index(np.argmax(gain), gain.shape)
    out = np.empty_like(gradient)
    value = -gs[:, i, j] / (hs[:, i, j] + 1)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = value
    return out, float(gain[i, j] - g[-1, -1] ** 2 / (h[-1, -1] + 1))


class AdditiveModel:
    """Bin edges, a table for each measure and a grid for each chosen pair; its size doesn't depend on the corpus."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, rate: float = 0.1) -> None:
        p = (y.sum() + 1) / (len(y) + 2)
        self.bias = float(np.log(p / (1 - p)))
        k = len(MEASURES)
        quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, i], quantiles, method="lower")) if len(x) else np.zeros(0) for i in range(k)]
        self.coarse = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, PAIR_BINS + 1)[1:-1], method="lower")) if len(x) else np.zeros(0) for i in range(k)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        if not len(y) or y.min() == y.max():
            return
        bins, grid = self._bins(x, self.edges), self._bins(x, self.coarse)
        total = np.full(len(y), self.bias)

        def slopes() -> tuple[np.ndarray, np.ndarray]:
            q = 1 / (1 + np.exp(-total))
            return q - y, q * (1 - q)

        for _ in range(rounds):
            for i in range(k):
                g, h = slopes()
                n = len(self.tables[i])
                leaves = rate * _tree(np.bincount(bins[:, i], g, n), np.bincount(bins[:, i], h, n))
                self.tables[i] += leaves
                total += leaves[bins[:, i]]

        def grids(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            g, h = slopes()
            shape = (len(self.coarse[i]) + 1, len(self.coarse[j]) + 1)
            cell = grid[:, i] * shape[1] + grid[:, j]
            return cell, np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape)

        gains = []
        for i in range(k):
            for j in range(i):
                if len(self.coarse[i]) and len(self.coarse[j]):
                    _, g, h = grids(j, i)
                    gains.append((_pair_tree(g, h)[1], j, i))
        chosen = [(i, j) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
        values = {p: np.zeros((len(self.coarse[p[0]]) + 1, len(self.coarse[p[1]]) + 1)) for p in chosen}
        for _ in range(pair_rounds):
            for i, j in chosen:
                cell, g, h = grids(i, j)
                leaves = rate * _pair_tree(g, h)[0]
                values[i, j] += leaves
                total += leaves.ravel()[cell]
        self.pairs = [(i, j, v) for (i, j), v in values.items()]

    @staticmethod
    def _bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges)], 1) if len(x) else np.zeros((0, len(edges)), int)

    def scores(self, x: np.ndarray) -> np.ndarray:
        bins, grid = self._bins(x, self.edges), self._bins(x, self.coarse)
        total = np.full(len(x), self.bias)
        for i, t in enumerate(self.tables):
            total += t[bins[:, i]]
        for i, j, v in self.pairs:
            total += v[grid[:, i], grid[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_modulus: int = 5, held_remainder: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each input row: doc_id, held_out, score and predicted.

    Labels are learnt only where crc32(id as text) modulo held_modulus isn't held_remainder, from a sample by hash of
    about TRAINING_ROWS of them. Null texts count as empty; empty texts have measures of zero. With labels of one class
    only, scores are the labels' smoothed mean. Repeated rows are scored each; an empty table gives an empty table; other
    columns are ignored; a row without an id counts as not held out.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    held = F.coalesce(remainder(id_col, held_modulus) == held_remainder, F.lit(False))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held.alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    measured = written(rows.mapInArrow(_measure, f"doc_id {kind}, held_out boolean, x array<float>"), "measures")
    known = labels.select(F.col(f"`{id_col}`").alias("label_id"), F.col(f"`{label_col}`").cast("int").alias("y")).where((F.col("y").isin(0, 1)) & (remainder("label_id", held_modulus) != held_remainder)).groupBy("label_id").agg(F.max("y").alias("y"))
    known = written(known, "labels")
    n = known.count()
    if n > TRAINING_ROWS:
        known = known.where(F.pmod(F.xxhash64("label_id", F.lit(13)), F.lit(1_000_000)) < TRAINING_ROWS * 1_000_000 // n)
    train = measured.join(known, F.col("doc_id") == F.col("label_id")).select("doc_id", "x", "y").toArrow()
    order = np.argsort(train["doc_id"].to_numpy(), kind="stable")
    x = np.array(train["x"].to_pylist(), np.float32).reshape(-1, len(MEASURES))[order]
    model = AdditiveModel(x, train["y"].to_numpy().astype(float)[order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.scores(b.column(2).flatten().to_numpy().reshape(-1, len(MEASURES)))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "held_out": b.column(1), "score": pa.array(s), "predicted": pa.array((s >= threshold).astype(np.int32))})

    return measured.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op9_additive_quality(spark, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
