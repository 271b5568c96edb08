"""SentencePiece models through the tokenizers library.

The model's protobuf is read field by field; its normaliser, space marker, unigram scores or merge order and byte
fallback are rebuilt as a tokenizers pipeline, whose encodings are checked against the sentencepiece library. Where no
piece goes on past a word into the next space marker, a word has the same pieces in every text: words that a worker meets
for the first time are encoded, compared with the sentencepiece library and decoded back many at once, in multithreaded
batches, and texts are put together from them. Whole texts are compared with the library by whole_text_parity.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import KEPT, few, table, tidy

MARK = "▁"
# Piece types and model types of the format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
#: Words, and letters in them, that a worker keeps with their ids; beyond either its table is emptied.
MOST_WORDS, MOST_LETTERS = 400_000, 8_000_000
#: Words that are encoded as one text.
JOINED = 64
THREADS = 2
#: Texts that a worker compares with the sentencepiece library before it encodes.
PROBES = ("", " ", "  two  spaces ", "plain words, and: marks!", "tab\tline\nend\r\n", "café über 日本語 \U0001f600", "a▁b <s> </s> <unk> <0x41>", "12345 67.89", "\u0000\u0001 x", "ALL CAPS aLtErNaTe", "ﬁ   ​")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def wire_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message: an integer for varints, else the bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind} is unknown")
        yield key >> 3, value


@dataclass
class PieceModel:
    """What encoding needs of a model file."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        m = cls()
        for number, value in wire_fields(data):
            if number == 1:
                piece = dict(wire_fields(value))
                m.pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, bytes(4)))[0], piece.get(3, NORMAL)))
            elif number == 2:
                spec = dict(wire_fields(value))
                m.kind, m.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
                if spec.get(24, 0):
                    raise ValueError("space markers at the end of words are not supported")
            elif number == 3:
                spec = dict(wire_fields(value))
                m.charsmap, m.dummy_prefix, m.squeeze, m.escape = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        if m.kind not in (UNIGRAM, BPE) or any(t == USER_DEFINED for _, _, t in m.pieces):
            raise ValueError("only unigram and BPE models without user-defined pieces are supported")
        return m

    def merges(self) -> list[tuple[str, str]]:
        """Pairs in the order in which BPE takes them: by the score of what they make."""
        ids = {p: i for i, (p, _, t) in enumerate(self.pieces) if t == NORMAL}
        found = []
        for piece, score, kind in self.pieces:
            if kind == NORMAL:
                found += [(-score, ids[piece], ids[piece[:k]], ids[piece[k:]]) for k in range(1, len(piece)) if piece[:k] in ids and piece[k:] in ids]
        return [(self.pieces[a][0], self.pieces[b][0]) for _, _, a, b in sorted(found)]

    def words_apart(self) -> bool:
        """No piece holds a space marker after another character."""
        return self.escape and not any(MARK in p.lstrip(MARK) for p, _, t in self.pieces if t == NORMAL)

    def build(self):
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        unknown = next(i for i, (_, _, t) in enumerate(self.pieces) if t == UNKNOWN)
        if self.kind == UNIGRAM:
            # Pieces that aren't text lose against any that are, so their names inside a text stay text.
            model = models.Unigram([(p, s if t == NORMAL else -1e9) for p, s, t in self.pieces], unknown, self.byte_fallback)
        else:
            model = models.BPE({p: i for i, (p, _, _) in enumerate(self.pieces)}, self.merges(), unk_token=self.pieces[unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        t = Tokenizer(model)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(" "))
        if self.escape:
            steps.append(normalizers.Replace(" ", MARK))
        t.normalizer = normalizers.Sequence(steps)
        t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()] + ([decoders.Strip(" ", 1, 0)] if self.dummy_prefix else []))
        return t


class PieceEncoder:
    """Encodes and decodes with one model file; raises ValueError if its encodings of PROBES aren't sentencepiece's."""

    _WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    def __init__(self, path: str, threads: int = THREADS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        import sentencepiece

        with open(path, "rb") as f:
            data = f.read()
        m = self.model = PieceModel.parse(data)
        self.tokenizer = m.build()
        self.normalise = self.tokenizer.normalizer.normalize_str
        self.plain = not m.charsmap and not m.squeeze and m.escape
        self.heads = np.array([p.startswith(MARK) for p, _, _ in m.pieces])
        self.apart = m.words_apart() and any(p == MARK and t == NORMAL for p, _, t in m.pieces)
        if self.apart:
            from tokenizers import normalizers

            self.tokenizer.normalizer = normalizers.Sequence([])
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.forget()
        probes = list(PROBES)
        if self.encode(probes) != self.reference(probes):
            raise ValueError("the rebuilt tokenizer and sentencepiece disagree")

    def forget(self) -> None:
        """Empties the table of words: their numbers, then by number where their ids are, whether decoding gives them back, and whether the library has the same ids."""
        self.words: dict[str, int] = {}
        self.letters = 0
        self.ids, self.start, self.back = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, bool)
        self.same = np.zeros(0, bool)

    def normalised(self, text: str) -> str:
        if self.plain:
            return (MARK * self.model.dummy_prefix + text.replace(" ", MARK)) if text else ""
        return self.normalise(text)

    def split(self, text: str) -> list[str]:
        """The words of a text, each with the markers before it, but for one that is followed by letters; a word without any has one behind it."""
        if self.plain and self.model.dummy_prefix and text and MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [w[1:] if w.rfind(MARK) == 0 and len(w) > 1 else w if w[0] == MARK else w + MARK for w in self._WORD.findall(self.normalised(text))]

    def _learn(self, fresh: list[str]) -> None:
        """Enters words with their ids."""
        usual = [w for w in fresh if MARK not in w]
        others = [w for w in fresh if MARK in w]
        parts = [usual[k : k + JOINED] for k in range(0, len(usual), JOINED)]
        joined = [MARK + MARK.join(p) for p in parts]
        found: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        back: list[np.ndarray] = []
        agree: list[np.ndarray] = []
        for part, text, x in zip(parts, joined, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(x.ids, np.int32)
            at = np.flatnonzero(self.heads[ids])
            if len(at) != len(part) or at[0]:
                raise ValueError("a piece crosses the border of a word")
            found.append(ids)
            sizes.append(np.diff(at, append=len(ids)))
            same = self._decoded([x.ids]) == [text]
            apart = [] if same else [y.tolist() for y in np.split(ids, at[1:])]
            back.append(np.ones(len(part), bool) if same else np.array([d == MARK + w for d, w in zip(self._decoded(apart), part, strict=True)]))
            if self.plain and self.reference([text.replace(MARK, " ")[self.model.dummy_prefix :]]) != [x.ids]:
                agree.append(np.array([y.tolist() == z for y, z in zip(np.split(ids, at[1:]), self._alone([MARK + w for w in part]), strict=True)]))
            else:
                agree.append(np.ones(len(part), bool))
        whole = [w if w[0] == MARK else w[:-1] for w in others]
        lists = [x.ids for x in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)]
        found += [np.array(x, np.int32) for x in lists]
        sizes.append(np.array([len(x) for x in lists], np.int64))
        back.append(np.array([d == w for d, w in zip(self._decoded(lists), whole, strict=True)], bool))
        agree.append(np.array([not self.plain or x == y for x, y in zip(lists, self._alone(whole), strict=True)], bool))
        n = len(self.words)
        self.words.update(zip(chain(usual, others), range(n, n + len(fresh)), strict=True))
        self.letters += sum(map(len, fresh))
        self.ids = np.concatenate([self.ids, *found])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(np.concatenate(sizes))])
        self.back = np.concatenate([self.back, *back])
        self.same = np.concatenate([self.same, *agree])

    def _alone(self, words: list[str]) -> list[list[int]]:
        """The library's ids of words with their markers; it has none for an empty text, but one for a text's last space."""
        found = self.reference([w.replace(MARK, " ")[self.model.dummy_prefix :] for w in words])
        return [x if w != MARK else [self.library.piece_to_id(MARK)] for x, w in zip(found, words, strict=True)]

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts in a row, where each text's ids start, with the end, whether decoding gives each text back
        as normalised, and whether the library has the same ids: for each of its words if words are encoded apart and texts
        aren't changed before, else for the whole text."""
        if not self.apart:
            lists = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            prefix = int(self.model.dummy_prefix)
            back = [d == self.normalised(t).replace(MARK, " ")[prefix:] for d, t in zip(self.decode(lists), texts, strict=True)]
            ids, at = np.array([i for x in lists for i in x], np.int32), np.cumsum([0] + [len(x) for x in lists])
            return ids, at, np.array(back, bool), self.compared(texts, ids, at)[0]
        if len(self.words) > MOST_WORDS or self.letters > MOST_LETTERS:
            self.forget()
        split = [self.split(t) for t in texts]
        known = self.words
        if fresh := [w for w in set(chain.from_iterable(split)) if w not in known]:
            self._learn(fresh)
        first = np.cumsum([0] + [len(ws) for ws in split])
        word = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, int(first[-1]))
        start = self.start[word]
        size = self.start[word + 1] - start
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
        none = lambda bad: (n := np.concatenate([[0], np.cumsum(bad)]))[first[1:]] == n[first[:-1]]
        return ids, ends[first], none(~self.back[word]), none(~self.same[word]) if self.plain else self.compared(texts, ids, ends[first])[0]

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, at, _, _ = self.encode_flat(texts)
        return [ids[s:e].tolist() for s, e in zip(at[:-1], at[1:], strict=True)]

    def compared(self, texts: list[str], ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """Whether the ids of each whole text are the library's, and those."""
        theirs = self.reference(texts)
        sizes = np.fromiter(map(len, theirs), np.int64, len(theirs))
        same = sizes == np.diff(at)
        if same.all():
            unlike = np.flatnonzero(np.fromiter(chain.from_iterable(theirs), np.int32, len(ids)) != ids)
            same[np.searchsorted(at, unlike, "right") - 1] = False
        else:
            same = np.array([ids[s:e].tolist() == x for s, e, x in zip(at[:-1], at[1:], theirs, strict=True)], bool)
        return same, theirs

    def agreed(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The encodings in a row and where they start, with the library's own for texts on which the two disagree."""
        ids, at, _, same = self.encode_flat(texts)
        if same.all():
            return ids, at
        lists = [ids[s:e] if ok else np.array(self.reference([t])[0], np.int32) for s, e, ok, t in zip(at[:-1], at[1:], same, texts, strict=True)]
        return np.concatenate(lists), np.cumsum([0] + [len(x) for x in lists])

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)

    def _decoded(self, ids: list[list[int]]) -> list[str]:
        """Decoded texts of words, with markers for spaces, and with the first one, that decoding strips."""
        return [MARK * (self.model.dummy_prefix and bool(x) and bool(self.heads[x[0]])) + d.replace(" ", MARK) for d, x in zip(self.decode(ids), ids, strict=True)]

    def reference(self, texts: list[str]) -> list[list[int]]:
        """The sentencepiece library's encodings."""
        return self.library.encode(texts, num_threads=1)


_encoders: dict[str, PieceEncoder] = KEPT.setdefault(__name__, {})


def encoder(path: str) -> PieceEncoder:
    """A worker's encoder of a file, kept for later tasks of this operator."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def _groups(texts: list[str], size: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about so many characters."""
    lo = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size or i == len(texts) - 1:
            yield lo, i + 1
            lo, total = i + 1, 0


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs but the text's, and token_ids and n_tokens.

    path: the model's file, which every executor has. Null texts count as empty and have no tokens; no begin or end
    tokens; columns of docs named token_ids or n_tokens give way to the new ones. Where the rebuilt tokenizer and the
    sentencepiece library disagree, the ids are the library's.
    """
    rest = [c for c in docs.columns if c not in (text_col, "token_ids", "n_tokens")]
    schema = docs.select(*[F.col(f"`{c}`") for c in rest]).schema.add("token_ids", T.ArrayType(T.IntegerType())).add("n_tokens", "long")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in few(batches):
            texts = [t or "" for t in b.column(len(rest)).to_pylist()]
            for lo, hi in _groups(texts):
                ids, at = e.agreed(texts[lo:hi])
                columns = [c.slice(lo, hi - lo) for c in b.columns[: len(rest)]] + [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids, pa.int32())), pa.array(np.diff(at))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text_col}`")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, ids_col: str = "token_ids", text_col: str = "text") -> DataFrame:
    """encoded with a column text_col decoded from ids_col, which goes; null ids give an empty text."""
    rest = [c for c in encoded.columns if c not in (ids_col, text_col)]
    schema = encoded.select(*[F.col(f"`{c}`") for c in rest]).schema.add(text_col, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            ids = [x or [] for x in b.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(e.decode(ids), pa.string())], names=schema.names)

    return encoded.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{ids_col}`")).mapInArrow(run, schema)


def verify(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_tokens, ids_sha256 (of little-endian 32-bit ids), word_parity and round_trip.

    word_parity: the sentencepiece library has the same ids for each of the text's words (for the whole text where words
    aren't encoded apart; whole_text_parity compares whole texts with any model). round_trip: decoding gives the text as
    normalised, spaces for markers. Both are looked at when a worker first meets a word, and a text's words decide on the
    text. Null texts count as empty: no tokens, both hold. Repeated rows come out each; an empty table gives an empty
    table; other columns are ignored.
    """

    def row(e: PieceEncoder, part: list[str]) -> dict:
        ids, at, back, same = e.encode_flat(part)
        data = ids.astype("<i4", copy=False)
        shas = [hashlib.sha256(data[f:t]).hexdigest() for f, t in zip(at[:-1], at[1:], strict=True)]
        return {"n_tokens": pa.array(np.diff(at)), "ids_sha256": pa.array(shas, pa.string()), "word_parity": pa.array(same), "round_trip": pa.array(back)}

    return _by_text(docs, path, id_col, text_col, row, "n_tokens long, ids_sha256 string, word_parity boolean, round_trip boolean")


def whole_text_parity(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_tokens and parity: the sentencepiece library gives the whole text the same ids.

    Null texts count as empty; repeated rows come out each; an empty table gives an empty table; other columns are ignored.
    """

    def row(e: PieceEncoder, part: list[str]) -> dict:
        ids, at, _, _ = e.encode_flat(part)
        return {"n_tokens": pa.array(np.diff(at)), "parity": pa.array(e.compared(part, ids, at)[0])}

    return _by_text(docs, path, id_col, text_col, row, "n_tokens long, parity boolean")


def _by_text(docs: DataFrame, path: str, id_col: str, text_col: str, row, columns: str) -> DataFrame:
    """doc_id and what row makes of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for lo, hi in _groups(texts):
                yield pa.RecordBatch.from_pydict({"doc_id": b.column(0).slice(lo, hi - lo)} | row(e, texts[lo:hi]))

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"doc_id {kind}, {columns}")


def op10_sentencepiece_tokenizers(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return verify(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def pieces_whole_text_parity(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return whole_text_parity(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
