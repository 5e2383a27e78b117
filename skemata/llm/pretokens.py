"""Pre-tokens of a byte-level BPE file, cut as the tokenizers library cuts them.

The library's tables of letters and digits are of one Unicode version, the ``regex``
package's of another.  ``letter_classes`` asks the library which code points it takes for
which class, once, on the driver; workers get the classes as text.  A text without any
code point on which the two disagree is cut by ``regex``, any other one by ranges.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import regex

# Fixed value: how this kind of vocabulary cuts a text before it merges.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
CODE_POINTS = 0x110000


class Classes(NamedTuple):
    """Bodies of character classes: the library's own, and where ``regex`` differs."""

    letters: str
    numbers: str
    blanks: str
    disputed: str


def _ranges(flags: np.ndarray) -> str:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return "".join(
        f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)
    )


def _flags(pattern: str, text: str, at: np.ndarray) -> np.ndarray:
    out = np.zeros(CODE_POINTS, dtype=bool)
    for match in regex.finditer(pattern, text):
        out[at[match.start() : match.end()]] = True
    return out


@lru_cache(maxsize=1)
def letter_classes() -> Classes:
    """Neighbouring code points of one class stay in one piece, so the pieces of all code
    points in a row are the classes' ranges; one probe per range tells which class it is."""
    from tokenizers.pre_tokenizers import ByteLevel

    cut = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str

    def whole(text: str) -> bool:
        return len(cut(text)) == 1

    letters, numbers, blanks = (np.zeros(CODE_POINTS, dtype=bool) for _ in range(3))
    at = np.concatenate([np.arange(0xD800), np.arange(0xE000, CODE_POINTS)])
    spaces = np.array([chr(c).isspace() for c in at])
    for block, step in ((at[spaces], 1), (at[~spaces], 8192)):
        for begin in range(0, len(block), step):
            part = block[begin : begin + step]
            for _, (low, high) in cut("".join(map(chr, part))):
                one, run = chr(part[low]), part[low:high]
                if whole("a" + one):
                    letters[run] = True
                elif whole("1" + one):
                    numbers[run] = True
                elif not whole("!" + one):
                    blanks[run] = True
    text = "".join(map(chr, at))
    disputed = (
        (letters != _flags(r"\p{L}+", text, at))
        | (numbers != _flags(r"\p{N}+", text, at))
        | (blanks != _flags(r"\s+", text, at))
    )
    return Classes(_ranges(letters), _ranges(numbers), _ranges(blanks), _ranges(disputed))


class Cutter:
    """Cuts stretches of text into pre-tokens."""

    def __init__(self, classes: Classes):
        l, n, s, disputed = classes
        self._plain = regex.compile(PIECES).findall
        self._ranged = re.compile(
            f"'s|'t|'re|'ve|'m|'ll|'d| ?[{l}]+| ?[{n}]+| ?[^{s}{l}{n}]+|[{s}]+(?![^{s}])|[{s}]+"
        ).findall
        self._disputed = re.compile(f"[{disputed}]").search if disputed else lambda text: None
        self._runs = re.compile(f"[{s}]{{2,}}[^{s}]*").finditer
        # a space inside a run of blanks, or at its end where the text ends
        self._inner = re.compile(f" (?<=[{s}] )(?:[{s}]|\\Z)").search

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or not self._disputed(text):
            return self._plain(text)
        return self._ranged(text)

    def word(self, word: str) -> list[str]:
        """The pieces of a space and the word after it."""
        if word.isascii() and word.isalpha():
            return [" " + word]
        return self(" " + word)

    def stretches(self, text: str) -> list[tuple[str, list[str]]]:
        """The text as pairs of a stretch to cut and the words that follow it, each after
        one space.  No piece reaches over the place before a space, but for a space inside
        a run of blanks, so words may be cut, and remembered, one by one."""
        if not self._inner(text):
            first, *words = text.split(" ")
            return [(first, words)]
        out, begin = [], 0
        for run in self._runs(text):
            if run.start() > begin:
                first, *words = text[begin : run.start()].split(" ")
                out.append((first, words))
            out.append((run.group(), []))
            begin = run.end()
        if begin < len(text):
            first, *words = text[begin:].split(" ")
            out.append((first, words))
        return out


class Remembered(dict):
    """Remembers what ``make`` gave for a key.  A full table becomes the old one, whose
    keys move back when they are met again, so what is in use stays."""

    def __init__(self, make, most: int, longest: int = 64):
        super().__init__()
        self._make, self._most, self._longest, self._old = make, most, longest, {}

    def __missing__(self, key):
        found = self._old.get(key)
        if found is None:
            found = self._make(key)
        if len(key) > self._longest:
            return found
        if len(self) >= self._most:
            self._old = dict(self)
            self.clear()
        self[key] = found
        return found


def special_tokens(vocab_path: str) -> dict[str, int]:
    """The strings that a vocabulary file takes for single tokens, with their ids."""
    with open(vocab_path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def special_pattern(special: dict[str, int]) -> re.Pattern | None:
    longest_first = sorted(special, key=len, reverse=True)
    return re.compile("|".join(map(re.escape, longest_first))) if special else None
