"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding.

Every prefix of a piece has exactly one token that its encoding ends with.  An
automaton over the vocabulary lists, for each prefix, the tokens that are
suffixes of it; the last token is the one among them that is compatible with
the last token of what it leaves in front.  Two tokens are compatible if encoding
their joined bytes gives back just the two.  The ids are read off by
following the stored tokens back from the end.  Work is linear in a piece's length,
also for pieces of megabytes.

Defined cases: a null or empty text has no tokens and decodes to an empty text;
special tokens of the vocabulary file found in a text are single tokens, as the
file says; equal rows give equal rows; an empty table gives an empty result;
other columns pass through, and one named like an output is replaced.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructField, StructType

from skemata.llm.common import without
from skemata.llm.pretokens import Classes, Cutter, Remembered, letter_classes, special_pattern
from skemata.llm.wordhash import text_slices

# Pairs, pieces and words remembered by a worker.
PAIRS_REMEMBERED = 300_000
PIECES_REMEMBERED = 100_000
WORDS_REMEMBERED = 300_000
NEVER = 1 << 60


def printable_bytes() -> dict[str, int]:
    """The character by which a vocabulary file writes each byte: itself where it is
    visible, else the next free character from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokens:
    """What decoding needs: the bytes of each token."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._read(spec)

    def _read(self, spec: dict) -> None:
        byte_of = printable_bytes()
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for name, token in ids.items():
            if name not in self.special:
                self.bytes_of[token] = bytes(byte_of[c] for c in name)
        for name, token in self.special.items():
            self.bytes_of[token] = name.encode()

        self.sizes = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.joined = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """Texts of the ids between each two bounds; bytes that are no UTF-8 are replaced."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0)
        at += np.repeat(self.starts[ids] - (ends - sizes), sizes)
        data = self.joined[at]
        offsets = np.concatenate([[0], ends])[bounds]
        raw = data.tobytes()
        heads = data[offsets[:-1][offsets[:-1] < offsets[1:]]]
        try:
            raw.decode()  # whole, and every text begins with a character
            whole = not np.any((heads & 0xC0) == 0x80)
        except UnicodeDecodeError:
            whole = False
        if whole:
            buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)]
            return pa.Array.from_buffers(pa.string(), len(bounds) - 1, buffers)
        cuts = zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
        return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in cuts], pa.string())


class Vocabulary(Tokens):
    """What encoding needs besides: merges, the automaton, and what is remembered."""

    def _read(self, spec: dict) -> None:
        super()._read(spec)
        ids = spec["model"]["vocab"]
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}  # pair: (rank, token)
        self.halves: dict[int, tuple[int, int, int]] = {}  # token: (rank, left, right)
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            token = ids[left + right]
            self.merged[ids[left], ids[right]] = (rank, token)
            self.halves.setdefault(token, (rank, ids[left], ids[right]))
        self.automaton = ahocorasick.Automaton()
        for name, token in ids.items():
            if name not in self.special and (token in self.halves or len(name) == 1):
                text = self.bytes_of[token].decode("latin-1")
                self.automaton.add_word(text, token)
        self.automaton.make_automaton()
        self.lengths = self.sizes.tolist()
        self.fits = Remembered(self._compatible, PAIRS_REMEMBERED)

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at one edge while ``token`` is built, bytes first, each with the
        rank of the merge that consumes it."""
        out, rank = [], NEVER
        while True:
            out.append((token, rank))
            if token not in self.halves:
                return out[::-1]
            rank, token = self.halves[token][0], self.halves[token][side]

    def compatible(self, left: int, right: int) -> bool:
        return self.fits[left, right]

    def _compatible(self, pair: tuple[int, int]) -> bool:
        """Whether the bytes of both, encoded together, stay these two tokens.

        Walks through the merges of both sides in rank order and looks whether the
        pair at the seam would be merged before either of its halves is consumed.  Of
        equal ranks the one further left goes first.
        """
        a, b = self._edge(pair[0], 2), self._edge(pair[1], 1)
        i = j = 0
        while True:
            (x, x_rank), (y, y_rank) = a[i], b[j]
            seam = self.merged.get((x, y), (NEVER,))[0]
            if seam < x_rank and seam <= y_rank and seam != NEVER:
                return False
            if x_rank == y_rank == NEVER:
                return True
            if x_rank <= y_rank:
                i += 1
            else:
                j += 1

    def _last_tokens(self, piece: bytes) -> list[int]:
        """The last token of every prefix, in the order of their ends; -1 for a prefix that
        no encoding ends at."""
        last = [-1] * len(piece)
        fits, sizes, done = self.fits, self.lengths, -1
        for at, token in self.automaton.iter(piece.decode("latin-1")):
            if at == done:
                continue  # a prefix has one last token only
            start = at - sizes[token]
            if start >= 0:
                before = last[start]
                if before < 0 or not fits[before, token]:
                    continue
            last[at] = token
            done = at
        return last

    def count_piece(self, piece: bytes) -> int:
        last, n, at = self._last_tokens(piece), 0, len(piece) - 1
        while at >= 0:
            n, at = n + 1, at - self.lengths[last[at]]
        return n

    def encode_piece(self, piece: bytes) -> list[int]:
        last, out, at = self._last_tokens(piece), [], len(piece) - 1
        while at >= 0:
            out.append(last[at])
            at -= self.lengths[last[at]]
        out.reverse()
        return out


class Encoder:
    """Texts to ids: special tokens first, then words and pieces, each remembered."""

    def __init__(self, path: str, classes: Classes):
        self.vocabulary = vocabulary(path)
        self.cut = Cutter(classes)
        self.special = self.vocabulary.special
        self.pattern = special_pattern(self.special)
        self.pieces = Remembered(self._piece, PIECES_REMEMBERED)
        self.words = Remembered(self._word, WORDS_REMEMBERED)

    def _piece(self, piece: str) -> bytes:
        return array("i", self.vocabulary.encode_piece(piece.encode())).tobytes()

    def _word(self, word: str) -> bytes:
        pieces = self.cut.word(word)
        if len(pieces) == 1:  # the word itself is remembered
            return self._piece(pieces[0])
        return b"".join(map(self.pieces.__getitem__, pieces))

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a stretch of text, as int32 bytes."""
        return b"".join(map(self.pieces.__getitem__, self.cut(chunk)))

    def _plain(self, text: str, out: list[bytes]) -> None:
        word = self.words.__getitem__
        for first, rest in self.cut.stretches(text):
            if first:
                out.append(self._chunk(first))
            out.extend(map(word, rest))

    def encode(self, text: str) -> bytes:
        """The ids of a text as int32 bytes."""
        out, begin = [], 0
        if self.pattern is not None:
            for match in self.pattern.finditer(text):
                self._plain(text[begin : match.start()], out)
                out.append(array("i", [self.special[match.group()]]).tobytes())
                begin = match.end()
        self._plain(text[begin:] if begin else text, out)
        return b"".join(out)


def extended(df: DataFrame, name: str, kind: DataType) -> StructType:
    return StructType([*df.schema.fields, StructField(name, kind)])


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One per worker process and file."""
    return Vocabulary(path)


@lru_cache(maxsize=4)
def tokens(path: str) -> Tokens:
    return Tokens(path)


@lru_cache(maxsize=4)
def encoder(path: str, classes: Classes) -> Encoder:
    return Encoder(path, classes)


def encode_texts(
    docs: DataFrame, vocab_path: str, text: str = "text", ids: str = "ids", decoded: str | None = None
) -> DataFrame:
    """``docs`` with the token ids of its texts, and with ``decoded``, if named, the texts
    that these ids stand for.  The file must be at ``vocab_path`` on every machine."""
    docs = without(docs, [ids] if decoded is None else [ids, decoded])
    at = docs.columns.index(text)
    names = [*docs.columns, ids] + ([] if decoded is None else [decoded])
    classes = letter_classes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = encoder(vocab_path, classes)
        for part in text_slices(batches, at, 1 << 20):
            found = [codes.encode(t) if t else b"" for t in part.column(at).to_pylist()]
            bounds = np.zeros(len(found) + 1, dtype=np.int32)
            np.cumsum([len(f) // 4 for f in found], out=bounds[1:])
            flat = np.frombuffer(b"".join(found), dtype=np.int32)
            columns = [*part.columns, pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))]
            if decoded is not None:
                columns.append(codes.vocabulary.decode(flat, bounds))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = extended(docs, ids, ArrayType(IntegerType()))
    return docs.mapInArrow(rows, schema if decoded is None else schema.add(decoded, StringType()))


def decode_texts(
    docs: DataFrame, vocab_path: str, ids: str = "ids", decoded: str = "decoded"
) -> DataFrame:
    """``docs`` with the texts that its token ids stand for."""
    docs = without(docs, [decoded])
    at = docs.columns.index(ids)
    names = [*docs.columns, decoded]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = tokens(vocab_path)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                lists = part.column(at)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                sizes = lists.value_lengths().fill_null(0)
                bounds = np.concatenate([[0], np.cumsum(sizes.to_numpy(zero_copy_only=False))])
                texts = codes.decode(flat, bounds.astype(np.int64))
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=names)

    return docs.mapInArrow(rows, extended(docs, decoded, StringType()))
