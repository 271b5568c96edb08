"""Token counts of byte-level BPE tokenizers by compiled transducers.

Two deterministic transducers are compiled from the tokenizer's file. The first reads character classes and emits the
borders of pre-tokens; texts are cut into chunks, every chunk's map from state to state is computed for all states at
once, the maps compose in a parallel prefix scan, and each chunk is then read from its known state. The second reads
the bytes of a pre-token: a state holds, for each suffix that may still grow into a token, the token before it, and a
transition is annotated with the change in emitted tokens. Its states are made when first reached.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

# Character classes; the letters that end contractions stand apart.
LETTER, STMD, R, V, ELL, E, NUMBER, OTHER, APOSTROPHE, SPACE, WHITE, BREAK = range(12)
_LETTERS = (LETTER, STMD, R, V, ELL, E)
# States: what the last character was.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, ONE_SPACE, LAST_SPACE, ONE_WHITE, LAST_WHITE, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, DONE = range(13)
# Emitted: a border before this character, before the last one.
HERE, BEFORE = 1, 2
# Code points with the White_Space property.
WHITE_SPACE = (9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
CHUNK = 64
#: Entries of a worker's tables, beyond which they are emptied and built anew.
MOST_KNOWN, MOST_STATES = 3_000_000, 250_000


def compile_borders() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emitted flags by state and class, for letter runs, number runs, runs of others (each with at most one space before), contractions and white space."""
    to, out = np.zeros((13, 12), np.uint8), np.zeros((13, 12), np.uint8)
    enter = {c: IN_LETTERS for c in _LETTERS} | {NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, APOSTROPHE: QUOTE, SPACE: ONE_SPACE, WHITE: ONE_WHITE}
    for state in range(13):
        for c, fresh in enter.items():
            to[state, c], out[state, c] = fresh, HERE
        to[state, BREAK] = START
    for state, inside in ((IN_LETTERS, _LETTERS), (IN_NUMBERS, (NUMBER,)), (IN_OTHERS, (OTHER, APOSTROPHE))):
        for c in inside:
            to[state, c], out[state, c] = state, 0
    for state in (ONE_SPACE, LAST_SPACE, ONE_WHITE, LAST_WHITE):
        far = BEFORE if state in (LAST_SPACE, LAST_WHITE) else 0
        for c in enter:
            if c in (SPACE, WHITE):
                to[state, c], out[state, c] = LAST_SPACE if c == SPACE else LAST_WHITE, 0
            elif state in (ONE_SPACE, LAST_SPACE):
                to[state, c], out[state, c] = IN_OTHERS if c == APOSTROPHE else enter[c], far
            else:
                out[state, c] = HERE | far
    for c, state in ((STMD, DONE), (R, QUOTE_R), (V, QUOTE_V), (ELL, QUOTE_L), (OTHER, IN_OTHERS), (APOSTROPHE, IN_OTHERS)):
        to[QUOTE, c], out[QUOTE, c] = state, 0
    for state, end in ((QUOTE_R, E), (QUOTE_V, E), (QUOTE_L, ELL)):
        to[state], out[state] = to[IN_LETTERS], out[IN_LETTERS] | BEFORE
        to[state, end], out[state, end] = DONE, 0
    return to, out


def classes() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    of = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    of[list(WHITE_SPACE)] = WHITE
    for chars, c in (("stmd", STMD), ("r", R), ("v", V), ("l", ELL), ("e", E), ("'", APOSTROPHE), (" ", SPACE)):
        of[[ord(x) for x in chars]] = c
    return of


def borders(cls: np.ndarray, to: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Whether a pre-token starts at each place of the classes; BREAK places stand between texts."""
    n = -(-len(cls) // CHUNK)
    grid = np.full((CHUNK, n), BREAK, np.uint8)
    padded = np.full(n * CHUNK, BREAK, np.uint8)
    padded[: len(cls)] = cls
    grid[:] = padded.reshape(n, CHUNK).T
    flat = to.ravel()
    maps = np.repeat(np.arange(13, dtype=np.uint8)[:, None], n, 1)
    row = maps.astype(np.int16)
    for t in range(CHUNK):
        row = flat[row * 12 + grid[t]].astype(np.int16)
    maps = row.astype(np.uint8)
    # Inclusive prefix scan: maps[:, i] becomes the composition of chunks 0 to i.
    step, columns = 1, np.arange(n)
    while step < n:
        maps[:, step:] = maps[maps[:, :-step], columns[step:]]
        step *= 2
    state = np.concatenate([[START], maps[START, :-1]]).astype(np.int16)
    emitted = np.empty((CHUNK, n), np.uint8)
    flat_out = out.ravel()
    for t in range(CHUNK):
        at = state * 12 + grid[t]
        emitted[t], state = flat_out[at], flat[at].astype(np.int16)
    emitted = emitted.T.ravel()
    first = (emitted & HERE).astype(bool)
    first[:-1] |= (emitted[1:] & BEFORE).astype(bool)
    return first[: len(cls)]


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the file, by letter."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeTransducer:
    """Counts the tokens of pre-tokens, byte by byte.

    A prefix's encoding ends in the one token whose neighbour to the left is stable against it: merging the two's bytes
    by rank gives the two tokens again. So it is enough to know, for each suffix that some token starts with, the token
    that ends before it and the count there relative to the count now; that is a state.
    """

    def __init__(self, model: dict) -> None:
        of = byte_letters()
        raw = lambda s: bytes(of[c] for c in s)
        self.ids = {raw(t): i for t, i in model["vocab"].items() if all(c in of for c in t)}
        self.bytes = {i: b for b, i in self.ids.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(pairs):
            a, b = raw(a), raw(b)
            self.rank[self.ids[a], self.ids[b]] = (r, self.ids[a + b])
        self.starts = {b[:n] for b in self.ids for n in range(1, len(b) + 1)}
        made = {m for _, m in self.rank.values()}
        self.ids = {b: i for b, i in self.ids.items() if len(b) == 1 or i in made}
        self.clear()

    def clear(self) -> None:
        self.stable: dict[tuple[int, int], bool] = {}
        # a state: for each suffix, its bytes, the token before it (-1: none) and the relative count
        self.states: list[tuple[tuple[bytes, int, int], ...]] = [((b"", -1, 0),)]
        self.number = {self.states[0]: 0}
        self.steps: dict[int, tuple[int, int]] = {}

    def merged(self, data: bytes) -> list[int]:
        """The tokens of data by repeated merging of the first pair of lowest rank."""
        ids = [self.ids[bytes([b])] for b in data]
        while len(ids) > 1:
            best = min((self.rank.get(p, (1 << 60, 0)), i) for i, p in enumerate(zip(ids, ids[1:], strict=False)))
            if best[0][0] == 1 << 60:
                break
            ids[best[1] : best[1] + 2] = [best[0][1]]
        return ids

    def _stable(self, a: int, b: int) -> bool:
        known = self.stable.get((a, b))
        if known is None:
            known = self.stable[a, b] = self.merged(self.bytes[a] + self.bytes[b]) == [a, b]
        return known

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        grown = [(s + bytes([byte]), last, n) for s, last, n in self.states[state]]
        for s, last, n in grown:
            token = self.ids.get(s)
            if token is not None and (last < 0 or self._stable(last, token)):
                break
        else:
            raise ValueError("no token ends here")
        delta = n + 1
        following = tuple((s, last, n - delta) for s, last, n in grown if s in self.starts) + ((b"", token, 0),)
        number = self.number.get(following)
        if number is None:
            number = self.number[following] = len(self.states)
            self.states.append(following)
        self.steps[state << 8 | byte] = number, delta
        return number, delta

    def count(self, data: bytes) -> int:
        state = total = 0
        get = self.steps.get
        for b in data:
            found = get(state << 8 | b)
            state, delta = found if found else self._step(state, b)
            total += delta
        if len(self.states) > MOST_STATES:
            self.clear()
        return total


class TokenCounter:
    """Both transducers of one tokenizer file, and the counts of pre-tokens met so far by hash."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError("a byte-level BPE tokenizer without normaliser is expected")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.to, self.out = compile_borders()
        self.of = classes()
        self.merges = MergeTransducer(model)
        self.known, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def _pieces(self, text: str) -> tuple[list[str], int]:
        """The text between special strings, and their number."""
        pieces, n = [text], 0
        for s in self.special:
            if s in text:
                pieces = [p for x in pieces for p in x.split(s)]
                n = len(pieces) - 1
        return pieces, n

    def count(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        at, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= 2_000_000:
                out += self._count(texts[at : i + 1])
                at, size = i + 1, 0
        return out + self._count(texts[at:])

    def _count(self, texts: list[str]) -> list[int]:
        from .common import spans_hash

        if not texts:
            return []
        totals = np.zeros(len(texts), np.int64)
        pieces, owner = [], []
        for i, t in enumerate(texts):
            found, n = self._pieces(t)
            totals[i] += n
            pieces += found
            owner += [i] * len(found)
        joined = "\0".join(pieces)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(p) for p in pieces])
        ends = np.cumsum(lengths + 1) - 1
        cls = self.of[points]
        cls[ends[:-1]] = BREAK
        first = borders(cls, self.to, self.out)
        first[ends[:-1]] = False
        start = np.flatnonzero(first)
        if not len(start):
            return totals.tolist()
        piece = np.searchsorted(ends, start, "left")
        end = np.minimum(np.append(start[1:], len(points)), ends[piece])
        hashes = spans_hash(points, start, end)
        unique, at, of = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, unique)
        fresh = np.ones(len(unique), bool)
        inside = place < len(self.known)
        fresh[inside] = self.known[place[inside]] != unique[inside]
        if fresh.any():
            new = at[fresh]
            counts = np.array([self.merges.count(joined[s:e].encode("utf-8", "surrogatepass")) for s, e in zip(start[new].tolist(), end[new].tolist(), strict=True)], np.int32)
            if len(self.known) > MOST_KNOWN:
                keep = ~fresh
                old = self.counts[place[keep]]
                values = np.empty(len(unique), np.int32)
                values[keep], values[fresh] = old, counts
                self.known, self.counts = unique, values
            else:
                self.known = np.insert(self.known, place[fresh], unique[fresh])
                self.counts = np.insert(self.counts, place[fresh], counts)
            place = np.searchsorted(self.known, unique)
        np.add.at(totals, np.array(owner)[piece], self.counts[place][of])
        return totals.tolist()


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """A worker's counter of a file, kept for later tasks."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row for each input row: doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    path: the tokenizer's file, which every executor has. No begin, end or added tokens; special strings inside texts
    count as their one token, as the library's default has it. Null texts count as empty: 0 bytes, 0 tokens. Repeated
    rows are counted each, an empty table gives an empty table, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = c.count(texts)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n], pa.bool_())})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op6_transducer_token_count(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
