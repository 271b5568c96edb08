"""Toxicity by class-conditional Kneser-Ney models over words and over letter sequences.

Toxic and ordinary training texts give counts of words and of word pairs, in distributed tables that grow with the texts. The
vocabulary are the words that toxic texts hold three times or more. In both classes a word's chance backs off to how many
different words it follows, in all training texts (shared continuation counts), so expressions that are rare in one class
are smoothed by what both know; its evidence is the difference of the two log-likelihoods. Within words, four-letter sequences over an alphabet of 32 signs do the same, with shared lower orders. A text's evidence is its
mean by word (the length-normalised comparison) and its strongest words, of both models; a logistic calibration, fitted out
of fold, turns that into a score.

Evidence of up to MOST_KNOWN words goes to every task. Of more, the most frequent ones do, and the others stay in a table:
texts are joined to it by those of their words that it may hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, Words, chunks, fresh_name, mix, signed, table, tidy, without_ids, written
from .decontaminate import word_hashes

ORDER, BITS_PER_SIGN = 4, 5
SIGNS, CODES = 1 << BITS_PER_SIGN, 1 << (ORDER * BITS_PER_SIGN)
DISCOUNT, STRENGTH = 0.75, 2.0
#: 1, letters' mean, three strongest words by letters, log of the number of words, words' mean, strongest word.
FEATURES = 8
WORD_DISCOUNT, LEAST_WORDS, MOST_EVIDENCE = 0.75, 3, 8.0
#: Words whose evidence goes to every task, at 12 bytes each, and bits of the table that tells which others a text may have.
MOST_KNOWN, SIEVE_BITS = 1_000_000, 27
#: Labels, of 12 bytes each, that are broadcast at most.
BROADCAST_LABELS = 1_000_000
#: Sequences that a task holds before it counts them.
WAITING = 2_000_000
#: Labelled texts, at most about, that the calibration is fitted on; the counts use all of them.
CALIBRATION_ROWS = 20_000
THRESHOLD = 0.3


def _signs() -> np.ndarray:
    """The sign of each byte: border 0, letters, digits, three classes of other UTF-8 bytes, the rest."""
    of = np.full(256, SIGNS - 1, np.uint8)
    of[97:123] = np.arange(1, 27)
    of[48:58] = 27
    of[128:] = 28 + np.arange(128, 256) % 3
    return of


_SIGNS = _signs()


def sequences(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The code of every sequence that ends in a word or at its border, and the word's index: some words, or a part of a long one, at a time."""
    done = np.concatenate([[0], np.cumsum(w.end - w.start)])
    i = 0
    while i < len(w.start):
        j = max(i + 1, int(np.searchsorted(done, done[i] + SLICE_BYTES, "right")) - 1)
        n = w.end[i:j] - w.start[i:j]
        if j == i + 1 and n[0] > SLICE_BYTES:
            for at in range(0, int(n[0]) + 1, SLICE_BYTES):  # each part with the signs before it; the last ends at the border
                part = w.data[w.start[i] + at : min(w.start[i] + at + SLICE_BYTES, w.end[i])]
                before = _SIGNS[w.data[w.start[i] + at - ORDER + 1 : w.start[i] + at]] if at else np.zeros(ORDER - 1, np.uint8)
                code = _codes(np.concatenate([before, _SIGNS[part], np.zeros(int(at + SLICE_BYTES > n[0]), np.uint8)]))[ORDER - 1 :]
                yield code, np.full(len(code), i)
        else:
            size = n + ORDER
            word = np.repeat(np.arange(i, j), size)
            place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)  # the signs before a word, the word, its end
            letter = (place >= ORDER - 1) & (place < np.repeat(size, size) - 1)
            signs = np.zeros(len(place), np.uint8)
            signs[letter] = _SIGNS[w.data[(np.repeat(w.start[i:j], size) + place - (ORDER - 1))[letter]]]
            ends = place >= ORDER - 1
            yield _codes(signs)[ends], word[ends]
        i = j


def _codes(signs: np.ndarray) -> np.ndarray:
    """The last ORDER signs at each place as one number."""
    code = signs.astype(np.int32)
    out = code.copy()
    for k in range(1, ORDER):
        out[k:] |= code[:-k] << (BITS_PER_SIGN * k)
    return out


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """Log of toxic against ordinary probability of each sequence's last sign; counts: (2, CODES), ordinary first."""
    present = counts.sum(0) > 0
    lower = []
    for _ in range(ORDER - 1):
        continuation = present.reshape(SIGNS, -1).sum(0).astype(float)  # the first sign is the high one
        lower.append(continuation)
        present = continuation > 0
    shared = np.full(SIGNS, 1 / SIGNS)
    for continuation in reversed(lower):
        by = continuation.reshape(-1, SIGNS)
        total, kinds = by.sum(1, keepdims=True), (by > 0).sum(1, keepdims=True)
        base = np.resize(shared, by.shape)
        shared = np.where(total > 0, (np.maximum(by - DISCOUNT, 0) + DISCOUNT * kinds * base) / np.maximum(total, 1), base).ravel()
    base = np.resize(shared, (CODES // SIGNS, SIGNS))
    logs = []
    for c in counts:
        by = c.reshape(-1, SIGNS).astype(float)
        off = np.minimum(by, 1.0)
        weight = off.sum(1, keepdims=True) + STRENGTH
        logs.append(np.log((by - off + weight * base) / (by.sum(1, keepdims=True) + STRENGTH)).ravel())
    return (logs[1] - logs[0]).astype(np.float32)


def words_before(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The word before each word, as 32 bits (0 for a border), and the word; without closing marks."""
    v = word_hashes(w)
    u = np.empty(len(v), np.int32)
    u[1:] = (v[:-1] >> np.uint64(32)).astype(np.uint32).view(np.int32)
    u[w.first[:-1][w.counts > 0]] = 0
    return u, v


class Evidence:
    """Hashes of words, in order, with their evidence."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order].astype(np.float32)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The evidence of each word, 0 for unknown ones."""
        if not len(self.keys):
            return np.zeros(len(keys), np.float32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], np.float32(0))


NO_EVIDENCE = Evidence(np.zeros(0, np.uint64), np.zeros(0))


def features(w: Words, ratios: np.ndarray, known: Evidence = NO_EVIDENCE) -> np.ndarray:
    """A row of FEATURES for each text."""
    each = np.zeros(len(w.hashes))
    for code, word in sequences(w):
        lo, hi = word[0], word[-1] + 1
        each[lo:hi] += np.bincount(word - lo, ratios[code], hi - lo)
    out = np.zeros((len(w.first) - 1, FEATURES))
    out[:, 0] = 1
    doc = w.doc
    ranked = np.lexsort((-each, doc))
    n = w.counts
    has = np.flatnonzero(n)
    out[has, 1] = np.add.reduceat(each, w.first[:-1][has]) / n[has] if len(has) else 0
    for k in range(3):
        deep = np.flatnonzero(n > k)
        out[deep, 2 + k] = each[ranked[w.first[:-1][deep] + k]]
    out[has, 5] = np.log(n[has])
    if len(has) and len(known.keys):
        found = known.of(word_hashes(w))
        out[has, 6] = np.add.reduceat(found, w.first[:-1][has], dtype=float) / n[has]
        out[has, 7] = np.maximum.reduceat(found, w.first[:-1][has])
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression on scaled features, by Newton steps; the weights are for unscaled ones."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    mean[0], scale[0] = 0, 1
    z = (x - mean) / scale
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.5 * np.eye(len(w)), z.T @ (p - y) + 0.5 * w)
    w = w / scale
    w[0] -= (w[1:] * mean[1:]).sum()
    return w


def remainder(id_col: str, modulus: int) -> Column:
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % modulus


class ToxicModel:
    """Letter evidence, calibration weights, and word evidence: for every task, and in a table (key, value) if there is more."""

    def __init__(self, ratios: np.ndarray, weights: np.ndarray, known: Evidence = NO_EVIDENCE, rest: DataFrame | None = None) -> None:
        self.ratios, self.weights, self.known, self.rest = ratios, weights, known, rest

    def totals(self, w: Words) -> np.ndarray:
        return features(w, self.ratios, self.known) @ self.weights

    def local(self) -> ToxicModel:
        """Without the table, which tasks can't use."""
        return ToxicModel(self.ratios, self.weights, self.known)


def logistic(total: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


@tidy
def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word, group and number of the words of texts (text, toxic, fold), chunk by chunk."""
    for b in batches:
        group = b.column(2).to_numpy(zero_copy_only=False) * 2 + b.column(1).to_numpy(zero_copy_only=False)
        for lo, _, w in chunks(b.column(0), lower=True):
            v, of = word_hashes(w), group[w.doc + lo]
            for g in range(4):
                word, n = np.unique(v[of == g], return_counts=True)
                yield pa.RecordBatch.from_pydict({"v": pa.array(signed(word)), "g": pa.array(np.full(len(word), g, np.int8)), "n": pa.array(n.astype(np.int32))})


def _before(sieve: np.ndarray):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each word that the sieve lets through with the word before it, once for each chunk."""
        for b in batches:
            for _, _, w in chunks(b.column(0), lower=True):
                u, v = words_before(w)
                maybe = _passing(sieve, v)
                _, at = np.unique(mix(v[maybe] + u[maybe].view(np.uint32)), return_index=True)
                yield pa.RecordBatch.from_pydict({"v": pa.array(signed(v[maybe][at])), "u": pa.array(u[maybe][at])})

    return run


def word_evidence(train: DataFrame) -> DataFrame:
    """key, n (how often a word is there) and its evidence: by all texts (both) and by the texts of one fold only (fold0, fold1)."""
    groups = [f"n{g}" for g in range(4)]
    rows = train.select("text", "toxic", "fold").mapInArrow(_word_counts, "v long, g byte, n int")
    words = rows.groupBy("v").agg(*[F.sum(F.when(F.col("g") == g, F.col("n")).otherwise(0)).alias(f"n{g}") for g in range(4)])
    words = written(words.where(F.col("n1") + F.col("n3") >= LEAST_WORDS), "toxicvocabulary")
    before = train.select("text").mapInArrow(_before(_sieve(words.select(F.col("v").alias("key")))), "v long, u int").distinct()
    words = words.join(before.groupBy("v").agg(F.count("*").alias("kinds")), "v")
    by = lambda k: {"both": F.col(f"n{k}") + F.col(f"n{k + 2}"), "fold0": F.col(f"n{k}"), "fold1": F.col(f"n{k + 2}")}
    words = written(words, "toxicwords")
    whole = words.agg(*[F.sum(g).alias(g) for g in groups], F.sum("kinds").alias("kinds"), *[F.sum((by(k)[m] > 0).cast("long")).alias(f"types_{m}{k}") for k in (0, 1) for m in by(k)]).first()
    shared = F.col("kinds") / F.lit(float(whole["kinds"] or 1))

    def chance(m: str, k: int) -> Column:
        size = {"both": (whole[f"n{k}"] or 0) + (whole[f"n{k + 2}"] or 0), "fold0": whole[f"n{k}"] or 0, "fold1": whole[f"n{k + 2}"] or 0}[m]
        if not size:
            return shared
        return (F.greatest(by(k)[m] - WORD_DISCOUNT, F.lit(0.0)) + F.lit(WORD_DISCOUNT * whole[f"types_{m}{k}"]) * shared) / F.lit(float(size))

    evidence = lambda m: F.greatest(F.lit(-MOST_EVIDENCE), F.least(F.lit(MOST_EVIDENCE), F.log(chance(m, 1) / chance(m, 0)))).cast("float")
    n = (F.col("n0") + F.col("n1") + F.col("n2") + F.col("n3")).alias("n")
    return words.select(F.col("v").alias("key"), n, *[evidence(m).alias(m) for m in ("both", "fold0", "fold1")])


@tidy
def _of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of texts, once for each chunk."""
    for b in batches:
        for _, _, w in chunks(b.column(0), lower=True):
            yield pa.RecordBatch.from_pydict({"key": pa.array(signed(np.unique(word_hashes(w))))})


@tidy
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequence counts of a task's texts (text, toxic, fold), by fold and class."""
    total = np.zeros(4 * CODES, np.int64)
    waiting: list[np.ndarray] = []

    def add() -> None:
        total[:] += np.bincount(np.concatenate(waiting), minlength=4 * CODES)
        waiting.clear()

    for b in batches:
        group = (b.column(2).to_numpy(zero_copy_only=False) * 2 + b.column(1).to_numpy(zero_copy_only=False)).astype(np.int32)
        for lo, _, w in chunks(b.column(0), lower=True):
            base = group[w.doc + lo] * np.int32(CODES)
            for code, word in sequences(w):
                waiting.append(base[word] + code)
                if sum(map(len, waiting)) >= WAITING:
                    add()
    if waiting:
        add()
    by_group = total.reshape(4, CODES)
    used = np.flatnonzero(by_group.any(0))
    yield pa.RecordBatch.from_pydict({"code": pa.array(used, pa.int32())} | {f"n{g}": pa.array(by_group[g, used]) for g in range(4)})


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_modulus: int = 4, held_remainder: int = 2) -> ToxicModel:
    """A model from the labelled texts whose crc32(id as text) modulo held_modulus isn't held_remainder.

    Counts come from all of them: letter sequences are at most CODES rows on the driver, words and word pairs stay in tables
    but for the evidence of MOST_KNOWN words; the calibration uses a sample by hash of about CALIBRATION_ROWS. With labels of one class only, scores are the labels' smoothed mean.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("label_id"), F.col(f"`{label_col}`").cast("int").alias("toxic")).where("toxic IN (0, 1)").groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).where(remainder("doc_id", held_modulus) != held_remainder)
    # Few labels go to the texts, so that only labelled texts are moved; with many, both sides meet by a merge join.
    known = written(known, "toxiclabels")
    known = F.broadcast(known) if known.count() <= BROADCAST_LABELS else known.hint("merge")
    train = rows.join(known, F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2))).cast("int").alias("fold"))
    train = written(train, "toxictrain")
    stats = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n, positive = sum(stats.values()), stats.get(1, 0)
    if not positive or positive == n:
        w = np.zeros(FEATURES)
        p = (positive + 0.5) / (n + 1) if n else 0.05
        w[0] = np.log(p / (1 - p))
        return ToxicModel(np.zeros(CODES, np.float32), w)
    sums = train.select("text", "toxic", "fold").mapInArrow(_count, "code int, n0 long, n1 long, n2 long, n3 long").groupBy("code").agg(*[F.sum(f"n{g}").alias(f"n{g}") for g in range(4)]).toArrow()
    counts = np.zeros((4, CODES))
    at = sums["code"].to_numpy()
    for g in range(4):
        counts[g, at] = sums[f"n{g}"].to_numpy()
    sample = train if n <= CALIBRATION_ROWS else train.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < CALIBRATION_ROWS * 1_000_000 // n)
    table, rest = word_evidence(train), None
    head = table
    if (size := table.count()) > MOST_KNOWN:
        # The most frequent ones, from the power of two on that leaves at most MOST_KNOWN.
        numbers = {r["p"]: r["words"] for r in table.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count("*").alias("words")).collect()}
        power = min(p for p in [*numbers, 64] if sum(n for q, n in numbers.items() if q >= p) <= MOST_KNOWN)
        head, tail = (table.where(c) for c in (F.col("n") >= 2.0**power, F.col("n") < 2.0**power))
        rest = tail.select("key", F.col("both").alias("value"))
    arrow = head.toArrow()
    evidence = Evidence(arrow["key"].to_numpy().view(np.uint64), arrow["both"].to_numpy())
    if rest is not None:  # the calibration looks at the words of its own texts
        arrow = table.join(sample.select("text").mapInArrow(_of_texts, "key long").distinct(), "key", "left_semi").toArrow()
    halves = [Evidence(arrow["key"].to_numpy().view(np.uint64), arrow[f"fold{k}"].to_numpy()) for k in (1, 0)]
    other = [(log_ratios(counts[2:]), halves[0]), (log_ratios(counts[:2]), halves[1])]

    @tidy
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fold = b.column(2).to_numpy(zero_copy_only=False)
            for lo, hi, w in chunks(b.column(0), lower=True):
                both = [features(w, r, e) for r, e in other]
                x = np.where(fold[lo:hi, None] == 0, both[0], both[1])
                yield pa.RecordBatch.from_pydict({"x": pa.array(list(x), pa.list_(pa.float64())), "y": b.column(1).slice(lo, hi - lo)})

    found = sample.select("text", "toxic", "fold").mapInArrow(measure, "x array<double>, y int").toArrow()
    weights = fit_logistic(np.array(found["x"].to_pylist()), found["y"].to_numpy().astype(float))
    return ToxicModel(log_ratios(counts[:2] + counts[2:]), weights, evidence, rest)


def _sieve(rest: DataFrame) -> np.ndarray:
    """A table of 2**SIEVE_BITS bits, as bytes, with a bit for each key: of fixed size, filled by the tasks."""

    @tidy
    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = [(b.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - SIEVE_BITS)).astype(np.int64) for b in batches]
        at = np.unique(np.concatenate(places)) if places else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_pydict({"byte": pa.array((at >> 3).astype(np.int32)), "bit": pa.array((1 << (at & 7)).astype(np.int32))})

    found = rest.select("key").mapInArrow(bits, "byte int, bit int").groupBy("byte").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << SIEVE_BITS >> 3, np.uint8)
    out[found["byte"].to_numpy()] = found["bits"].to_numpy().astype(np.uint8)
    return out


def _passing(sieve: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where keys are that the sieve may hold: it lets a few others through."""
    place = (keys >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)
    return np.flatnonzero(sieve[place >> 3] >> (place & 7).astype(np.uint8) & 1)


def totals(rows: DataFrame, model: ToxicModel) -> DataFrame:
    """row (a long) and total, the calibrated evidence, of each row (row, text)."""
    if model.rest is None:

        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo, hi, w in chunks(b.column(1), lower=True):
                    yield pa.RecordBatch.from_pydict({"row": b.column(0).slice(lo, hi - lo), "total": pa.array(model.totals(w))})

        return rows.select("row", "text").mapInArrow(run, "row long, total double")
    sieve, own = _sieve(model.rest), model.local()

    @tidy
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, w in chunks(b.column(1), lower=True):
                x = features(w, own.ratios, own.known)
                key = word_hashes(w)
                maybe = _passing(sieve, key)
                cuts = np.searchsorted(maybe, w.first)
                keys = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(signed(key[maybe])))
                yield pa.RecordBatch.from_pydict({"row": b.column(0).slice(lo, hi - lo), "total": pa.array(x @ own.weights), "words": pa.array(w.counts.astype(np.int64)), "strongest": pa.array(x[:, 7]), "keys": keys})

    found = written(rows.select("row", "text").mapInArrow(parts, "row long, total double, words long, strongest double, keys array<long>"), "toxicparts")
    more = found.select("row", F.explode("keys").alias("key")).join(model.rest, "key").groupBy("row").agg(F.sum("value").alias("sum"), F.max("value").alias("most"))
    mean, strongest = (F.lit(float(x)) for x in own.weights[6:8])
    joined = found.drop("keys").join(more.withColumnRenamed("row", "of"), F.col("row") == F.col("of"), "left")
    # Words outside the first part count 0 there, so its strongest is at least 0 where the table adds any.
    return joined.select("row", (F.col("total") + F.coalesce(mean * F.col("sum") / F.col("words") + strongest * (F.greatest("strongest", "most") - F.col("strongest")), F.lit(0.0))).alias("total"))


def score(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text", held_modulus: int = 4, held_remainder: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each input row: doc_id, held_out, score and predicted.

    Null texts count as empty; empty texts get the score of no evidence. Repeated rows are scored each, an empty table
    gives an empty table, other columns are ignored. A row without an id counts as not held out.
    """

    kind = docs.schema[id_col].dataType.simpleString()
    held = F.coalesce(remainder(id_col, held_modulus) == held_remainder, F.lit(False))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held.alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    if model.rest is not None:
        rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "toxicrows")
        total = F.least(F.lit(30.0), F.greatest(F.lit(-30.0), "total"))
        scored = totals(rows, model).select("row", (1 / (1 + F.exp(-total))).alias("score"))
        return rows.drop("text").join(scored, "row").select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, w in chunks(b.column(2), lower=True):
                s = logistic(model.totals(w))
                yield pa.RecordBatch.from_pydict({"doc_id": b.column(0).slice(lo, hi - lo), "held_out": b.column(1).slice(lo, hi - lo), "score": pa.array(s), "predicted": pa.array((s >= threshold).astype(np.int32))})

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_ordinary(docs: DataFrame, model: ToxicModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, without the rows whose text scores threshold or more; null texts count as empty, repeated rows are judged each."""
    place = docs.columns.index(text_col)
    least = float(np.log(threshold / (1 - threshold)))
    if model.rest is not None:
        row = fresh_name(docs, "row")
        rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "toxicrows")
        gone = totals(rows.select(F.col(f"`{row}`").alias("row"), F.col(f"`{text_col}`").alias("text")), model).where(F.col("total") >= least)
        return without_ids(rows, gone.select("row"), row).drop(row)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.concatenate([model.totals(w) < least for _, _, w in chunks(b.column(place), lower=True)] or [np.zeros(0, bool)])
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op8_kneser_ney_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
