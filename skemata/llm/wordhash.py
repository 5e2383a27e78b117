"""Words and word shingles of UTF-8 texts as 64-bit hashes, in numpy.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``.  A word's hash is a
polynomial over its bytes, taken from prefix sums, so a whole block of texts is
hashed by a handful of array passes and no Python loop over words.  Texts are
cut at white space into blocks of bounded size: memory does not grow with the
length of a text beyond eight bytes per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

_RNG = np.random.default_rng(20240611)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE_FOLDED = _BYTE.copy()
_BYTE_FOLDED[65:91] = _BYTE_FOLDED[97:123]
_BASE = int(_RNG.integers(1 << 40, 1 << 62)) * 8 + 5
_WIDTH_KEYS = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with good avalanche (in place where possible)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        mask = (1 << 64) - 1
        inverse = pow(_BASE, -1, 1 << 64)
        up = np.empty(n, dtype=np.uint64)
        down = np.empty(n, dtype=np.uint64)
        for table, base in ((up, _BASE), (down, inverse)):
            table[0] = 1
            size, step = 1, base & mask
            while size < n:
                more = min(size, n - size)
                table[size : size + more] = table[:more] * np.uint64(step)
                size += more
                step = step * step & mask
        _powers.update(up=up, down=down)
    return _powers["up"], _powers["down"]


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array and n + 1 offsets; null counts as empty."""
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[
        texts.offset : texts.offset + len(texts) + 1
    ]
    if texts.buffers()[2] is None or offsets[-1] == offsets[0]:
        return np.empty(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(
    data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _SPACE
) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of the words; texts border words.

    ``gaps`` flags the byte values that words do not hold."""
    if not len(data):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    solid = ~gaps[data]
    before = np.empty(len(data), dtype=bool)
    before[0] = False
    before[1:] = solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(len(data), dtype=bool)
    after[-1] = False
    after[:-1] = solid[1:]
    after[inner - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends


def span_hashes(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool
) -> np.ndarray:
    """Hashes of byte spans, block by block; a span longer than a block is hashed alone."""
    out = np.empty(len(starts), dtype=np.uint64)
    table = _BYTE_FOLDED if fold else _BYTE
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            low = int(starts[i])
            j = max(i + 1, int(np.searchsorted(ends, low + BLOCK_BYTES, side="right")))
            high = int(ends[j - 1])
            up, down = _power_tables(max(BLOCK_BYTES, high - low) + 1)
            sums = np.empty(high - low + 1, dtype=np.uint64)
            sums[0] = 0
            values = table[data[low:high]]
            values *= up[: high - low]
            np.cumsum(values, out=sums[1:])
            s, e = starts[i:j] - low, ends[i:j] - low
            out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
            i = j
    return out


def text_words(texts: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and n + 1 offsets into them."""
    data, offsets = byte_view(texts)
    starts, ends = word_spans(data, offsets)
    return span_hashes(data, starts, ends, fold), np.searchsorted(starts, offsets)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words, across all texts."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        total = words[:n] * _WIDTH_KEYS[0]
        for k in range(1, width):
            total += words[k : k + n] * _WIDTH_KEYS[k]
    return mix(total)


def text_shingles(
    words: np.ndarray, offsets: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes (with repeats, in order) per text and n + 1 offsets.

    A text with fewer words than ``width`` has its whole sequence as its one
    shingle; a text without words has none.
    """
    counts = np.diff(offsets)
    per_text = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_offsets = np.zeros(len(offsets), dtype=np.int64)
    np.cumsum(per_text, out=out_offsets[1:])
    out = np.empty(int(out_offsets[-1]), dtype=np.uint64)
    windows = window_hashes(words, width)
    long = counts >= width
    first = np.repeat(offsets[:-1][long] - out_offsets[:-1][long], per_text[long])
    at = np.flatnonzero(np.repeat(long, per_text))
    out[at] = windows[first + at]
    with np.errstate(over="ignore"):
        for i in np.flatnonzero((counts > 0) & ~long):
            seq = words[offsets[i] : offsets[i + 1]]
            total = (seq * _WIDTH_KEYS[: len(seq)]).sum(dtype=np.uint64)
            out[out_offsets[i]] = mix(np.array([total + np.uint64(len(seq))]))[0]
    return out, out_offsets


def unique_per_text(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values in ascending order, with new offsets."""
    parts, counts = [], np.zeros(len(offsets), dtype=np.int64)
    for i in range(len(offsets) - 1):
        part = values[offsets[i] : offsets[i + 1]]
        if len(part) > 1:
            part = np.sort(part)
            keep = np.empty(len(part), dtype=bool)
            keep[0] = True
            np.not_equal(part[1:], part[:-1], out=keep[1:])
            part = part[keep]
        parts.append(part)
        counts[i + 1] = len(part)
    joined = np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)
    return joined, np.cumsum(counts)


def text_slices(batches, column: int | str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches cut to about ``most`` bytes of the text column each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column)
        sizes = np.asarray(pc.binary_length(texts).fill_null(0), dtype=np.int64)
        total = np.cumsum(sizes)
        begin = 0
        while begin < batch.num_rows:
            done = int(total[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, done + most, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end
