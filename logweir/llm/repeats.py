"""Passages that repeat across documents, found with sharded Aho-Corasick automata.

Every window of 50 words has an anchor, the smallest hash among its 43 phrases of 8 words, so equal windows share it.
Anchors seen in two documents mark the stretches that may repeat, and windows of those stretches that two documents hold
are confirmed. The document that has them first gives the passages: its runs of confirmed windows, with their words. The
passages' anchor phrases are compiled into automata, sharded by the document where an anchor first appears, and the
stretches of all documents stream through their shard's automaton. A phrase that it finds names the passages' windows
that hang on it; one of them that is there word for word is followed to both sides, and those words go. A document
without a recurring anchor has no stretch: none of its windows can be in another one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, dropped, mix, signed, table, windows_hash, written

WINDOW, PHRASE = 50, 8
_SPAN = WINDOW - PHRASE + 1
#: Words of a shard's passages, and stretches in a group that goes through its automaton, on average and at most.
SHARD_WORDS, GROUP_STRETCHES = 20_000, 400
_NONE = hashlib.sha256(b"").hexdigest()
_KEY = ["doc_id", "high", "low"]
_LONGS = pa.list_(pa.int64())


def _sliding(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchor of each window of a run of words, and the word where that phrase starts; of equal ones the first."""
    low = windows_hash(hashes, PHRASE)
    place = np.arange(len(low), dtype=np.int32)

    def least(shift: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        left = low[:n] <= low[shift : shift + n]
        return np.where(left, low[:n], low[shift : shift + n]), np.where(left, place[:n], place[shift : shift + n])

    width = 1
    while 2 * width <= _SPAN:
        low, place = least(width, max(0, len(low) - width))
        width *= 2
    return least(_SPAN - width, max(0, len(hashes) - WINDOW + 1))


def _anchors(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, text number and anchor of each window."""
    start, doc = w.windows(WINDOW)
    return start, doc, _sliding(w.hashes)[0][start]


def _window_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each window of a run of words, as two arrays."""
    return signed(windows_hash(words, WINDOW)), signed(windows_hash(mix(words ^ np.uint64(0xA5A5A5A55A5A5A5A)), WINDOW))


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, w in chunks(b.column(1)):
            _, doc, anchor = _anchors(w)
            fresh = np.ones(len(anchor), bool)
            fresh[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
            anchor, doc = anchor[fresh], doc[fresh]
            cuts = np.searchsorted(doc, np.arange(hi - lo + 1))
            high, low = w.whole()
            data = w.data.tobytes()
            shas = []
            for i in range(hi - lo):
                f, t = w.first[i], w.first[i + 1]
                shas.append(hashlib.sha256(b" ".join(data[w.start[f] : w.end[t - 1]].split())).hexdigest() if t > f else _NONE)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0).slice(lo, hi - lo), "n_words": pa.array(w.counts.astype(np.int64)), "high": pa.array(signed(high)), "low": pa.array(signed(low)), "whole_sha256": pa.array(shas, pa.string()), "anchors": pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(signed(anchor)))})


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the runs of windows whose anchors recur: one row for each run of one home."""
    for b in batches:
        ids, lists = b.column(0).to_pylist(), b.column(2)
        for lo, hi, w in chunks(b.column(1)):
            rows = []
            start, doc, anchor = _anchors(w)
            anchors, hashes = signed(anchor), signed(w.hashes)
            high, low = map(signed, w.whole())
            cuts = np.searchsorted(doc, np.arange(hi - lo + 1))
            for i in range(hi - lo):
                f, t = cuts[i], cuts[i + 1]
                found = lists[lo + i].values
                if f == t or not len(found):
                    continue
                known, homes = (found.field(k).to_numpy() for k in (0, 1))
                order = np.argsort(known)
                known, homes = known[order], homes[order]
                at = np.minimum(np.searchsorted(known, anchors[f:t]), len(known) - 1)
                hit = known[at] == anchors[f:t]
                home = np.where(hit, homes[at], -1)
                edge = np.flatnonzero(np.diff(home, prepend=home[0] - 1, append=home[-1] - 1) | np.diff(hit, prepend=not hit[0], append=not hit[-1]))
                for s, e in zip(edge[:-1], edge[1:], strict=True):
                    if hit[s]:
                        rows.append((ids[lo + i], high[i], low[i], home[s], start[f + s] - w.first[i], hashes[start[f + s] : start[f + e - 1] + WINDOW]))
            for k in range(0, len(rows), 500):
                columns = list(zip(*rows[k : k + 500], strict=True))
                kinds = (b.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int32(), _LONGS)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[*_KEY, "home", "start", "words"])


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists, and where each list starts, with the end."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64), offsets - offsets[0]


def _inside(offsets: np.ndarray) -> np.ndarray:
    """Starts of the windows that lie within one list."""
    n = np.maximum(np.diff(offsets) - WINDOW + 1, 0)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[:-1], n)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window of the stretches (doc_id, words)."""
    for b in batches:
        words, offsets = _flat(b.column(1))
        at = _inside(offsets)
        x, y = _window_keys(words)
        doc = b.column(0).to_numpy()[np.searchsorted(offsets, at, "right") - 1]
        yield pa.RecordBatch.from_pydict({"x": pa.array(x[at]), "y": pa.array(y[at]), "doc_id": pa.array(doc)})


def _passages(windows: pa.Table, stretches: pa.Table) -> pa.Table:
    """The runs of confirmed windows (x, y) of the document that has them first, with their words."""
    out: list[tuple[int, int, np.ndarray]] = []
    x, y = windows["x"].to_numpy(), windows["y"].to_numpy()
    order = np.argsort(x)
    x, y = x[order], y[order]
    for i in range(len(stretches) if len(x) else 0):
        words = stretches["words"][i].values.to_numpy().view(np.uint64)
        p, q = _window_keys(words)
        at = np.minimum(np.searchsorted(x, p), len(x) - 1)
        edge = np.flatnonzero(np.diff((x[at] == p) & (y[at] == q), prepend=False, append=False))
        out += [(stretches["home"][i].as_py(), stretches["doc_id"][i].as_py(), words[s : e + WINDOW - 1].view(np.int64)) for s, e in zip(edge[::2], edge[1::2], strict=True)]
    columns = list(zip(*out, strict=True)) or [()] * 3
    return pa.table({"home": pa.array(columns[0], pa.int64()), "first_doc": pa.array(columns[1], pa.int64()), "words": pa.array(columns[2], _LONGS)})


def _letters(words: np.ndarray) -> str:
    """A letter beyond the basic plane for each word."""
    return ((words >> np.uint64(20)).astype(np.uint32) % np.uint32(0x100000) + np.uint32(0x10000)).tobytes().decode("utf-32-le")


def automaton(words: np.ndarray, offsets: np.ndarray) -> ahocorasick.Automaton:
    """The anchor phrases of passages, each with the windows that hang on it: where a window of these words starts, by its hash."""
    found = ahocorasick.Automaton()
    phrases: dict[str, dict[int, int]] = {}
    text = _letters(words)
    _, place = _sliding(words)
    keys = windows_hash(words, WINDOW)
    at = _inside(offsets)
    for s, p, key in zip(at.tolist(), place[at].tolist(), keys[at].tolist(), strict=True):
        phrases.setdefault(text[p : p + PHRASE], {}).setdefault(key, s)
    for phrase, windows in phrases.items():
        found.add_word(phrase, windows)
    if phrases:
        found.make_automaton()
    return found


def _run(a: np.ndarray, i: int, b: np.ndarray, j: int) -> int:
    """How many words from a[i] and b[j] on are the same."""
    n = min(len(a) - i, len(b) - j)
    unlike = np.flatnonzero(a[i : i + n] != b[j : j + n])
    return int(unlike[0]) if len(unlike) else n


def _locate(passages: pa.Table, stretches: pa.Table) -> pa.Table:
    """Word ranges of the stretches in which passages of documents with smaller ids occur."""
    out: list[tuple[int, int, int]] = []  # row, from, to
    own, own_at = _flat(passages["words"]) if len(passages) else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
    words, at = _flat(stretches["words"]) if len(stretches) else (own, own_at)
    found = automaton(own, own_at)
    if len(found) and len(stretches):
        first, doc, offset = passages["first_doc"].to_numpy(), stretches["doc_id"].to_numpy(), stretches["start"].to_numpy()
        _, place = _sliding(words)
        keys = windows_hash(words, WINDOW)
        hang = np.zeros(len(words) + 1, np.int64)  # windows up to each word's phrase, whose places never fall
        inside = _inside(at)
        places = place[inside]
        hang = np.searchsorted(places, np.arange(len(words) + 1))
        row, free = -1, 0
        for end, windows in found.iter(_letters(words)):
            phrase = end - PHRASE + 1
            for k in range(hang[phrase], hang[phrase + 1]):
                s = int(inside[k])
                i = int(np.searchsorted(at, s, "right")) - 1
                if i != row:
                    row, free = i, 0
                if s + WINDOW <= free:
                    continue
                t = windows.get(int(keys[s]))
                if t is None:
                    continue
                p = int(np.searchsorted(own_at, t, "right")) - 1
                if first[p] < doc[i]:
                    n = _run(words[s : at[i + 1]], 0, own[t : own_at[p + 1]], 0)
                    if n >= WINDOW:
                        out.append((i, int(offset[i] + s - at[i]), int(offset[i] + s - at[i] + n)))
                        free = s + n
    rows = pa.array([x[0] for x in out], pa.int64())
    return pa.table({k: stretches[k].combine_chunks().take(rows) for k in _KEY} | {"from": pa.array([x[1] for x in out], pa.int32()), "to": pa.array([x[2] for x in out], pa.int32())})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What stays of the texts without those of the ranges (high, low, from, to) that are theirs."""
    for b in batches:
        column = b.column(1).cast(pa.binary()).to_pylist()
        for lo, hi, w in chunks(b.column(1)):
            high, low = map(signed, w.whole())
            removed, shas = [], []
            for i in range(lo, hi):
                words = (column[i] or b"").split()
                keep = np.ones(len(words), bool)
                for r in b.column(2)[i].as_py():
                    if (r["high"], r["low"]) == (high[i - lo], low[i - lo]):
                        keep[r["from"] : r["to"]] = False
                removed.append(int(len(words) - keep.sum()))
                shas.append(hashlib.sha256(b" ".join([words[k] for k in np.flatnonzero(keep)])).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0).slice(lo, hi - lo), "high": pa.array(high), "low": pa.array(low), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(shas, pa.string())})


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """survey, copies, involved and ranges, all written tables but the last.

    survey: a row for each input row with n_words and the hash of all its words. copies: id and hash of the texts whose
    word sequence, of 50 words or more, an earlier document has. involved: id and text of other documents that share an
    anchor with one. ranges: doc_id, high and low (the text's hash), from, to of words to remove in those.
    """
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    survey = written(docs.mapInArrow(_survey, "doc_id long, n_words long, high long, low long, whole_sha256 string, anchors array<long>"), "survey")
    long = survey.where((F.col("n_words") >= WINDOW) & F.col("doc_id").isNotNull())
    groups = written(long.groupBy("high", "low").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last").select("high", "low", "rep"), "copygroups")
    copies = written(long.select(*_KEY).join(groups, ["high", "low"]).where("doc_id > rep").select(*_KEY).distinct(), "copies")
    each = long.select(*_KEY, "anchors").join(copies, _KEY, "left_anti").select("doc_id", F.explode("anchors").alias("anchor"))
    recurring = written(each.groupBy("anchor").agg(F.min("doc_id").alias("home"), F.max("doc_id").alias("last")).where("home < last").select("anchor", "home"), "anchors")
    marked = each.join(recurring, "anchor").groupBy("doc_id").agg(F.collect_set(F.struct("anchor", "home")).alias("found"))
    involved = written(docs.join(marked, "doc_id").dropDuplicates(["doc_id", "text"]), "involved")
    stretches = written(involved.mapInArrow(_stretches, "doc_id long, high long, low long, home long, start int, words array<long>"), "stretches")
    windows = stretches.select("doc_id", "words").mapInArrow(_windows, "x long, y long, doc_id long")
    confirmed = written(windows.groupBy("x", "y").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last")).where("first_doc < last").drop("last"), "confirmed")
    passages = confirmed.groupBy("first_doc").cogroup(stretches.select("doc_id", "home", "words").groupBy("doc_id")).applyInArrow(_passages, "home long, first_doc long, words array<long>")
    passages = written(passages, "passages")
    dropped(confirmed)
    shards = max(1, -(-(passages.agg(F.sum(F.size("words"))).first()[0] or 0) // SHARD_WORDS))
    shard = F.pmod(F.xxhash64("home"), F.lit(shards)).alias("shard")
    # A shard that many stretches pass through is dealt to several groups, each with a copy of its passages.
    sizes = written(stretches.groupBy(shard).agg(F.ceil(F.count("*") / GROUP_STRETCHES).cast("int").alias("parts")), "shards")
    patterns = passages.select(shard, "first_doc", "words").join(sizes, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    routed = stretches.select(shard, *_KEY, "start", "words").join(sizes, "shard").withColumn("part", F.pmod(F.xxhash64("doc_id", "start"), F.col("parts")).cast("int"))
    keys = ["shard", "part"]
    ranges = patterns.drop("parts").groupBy(*keys).cogroup(routed.drop("parts").groupBy(*keys)).applyInArrow(_locate, "doc_id long, high long, low long, from int, to int")
    return survey, copies, involved, ranges


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_words, n_removed and kept_sha256 of the words that stay.

    A word goes if a window of 50 words of its document covers it that also starts in a document with a smaller id.
    Null and empty texts have no words; rows without an id are left whole and are nobody's source; rows that repeat an
    id are looked at each, whatever their texts; other columns are ignored. Windows are confirmed by 128 bits of hashes and
    occurrences by 64 bits for each word.
    """
    survey, copies, involved, ranges = repeated_ranges(docs, id_col, text_col)
    gone = ranges.groupBy("doc_id").agg(F.collect_set(F.struct("high", "low", "from", "to")).alias("ranges"))
    cut = involved.select("doc_id", "text").join(gone, "doc_id").mapInArrow(_cut, "doc_id long, high long, low long, n_removed long, kept_sha256 string")
    cut = cut.dropDuplicates(_KEY).select(*_KEY, F.col("n_removed").alias("cut_words"), F.col("kept_sha256").alias("cut_sha256"))
    rows = survey.drop("anchors").join(copies.withColumn("copy", F.lit(True)), _KEY, "left").join(cut, _KEY, "left")
    return rows.select("doc_id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("cut_words", F.lit(0))).alias("n_removed"), F.when(F.col("copy"), _NONE).otherwise(F.coalesce("cut_sha256", "whole_sha256")).alias("kept_sha256"))


def op5_repeated_phrase_automata(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50),
g AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 49], ' ')) AS s FROM p),
f AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s),
r AS (SELECT DISTINCT doc_id, i + o AS k FROM (SELECT g.doc_id, g.i, unnest(range(0, 50)) AS o FROM g JOIN f ON f.s = g.s WHERE f.first < g.doc_id)),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM d),
t AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.k) AS kept, count(*) AS n FROM w LEFT JOIN r ON r.doc_id = w.doc_id AND r.k = w.k WHERE r.k IS NULL GROUP BY w.doc_id)
SELECT d.doc_id, len(ws) AS n_words, len(ws) - coalesce(t.n, 0) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256 FROM d LEFT JOIN t ON t.doc_id = d.doc_id
"""
