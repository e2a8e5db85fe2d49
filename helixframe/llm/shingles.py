"""Word shingles of whole texts as 64-bit hashes, computed over Arrow buffers with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes hashed in one go, at some 50 bytes of memory each; a longer text is hashed alone.
CHUNK_BYTES = 1 << 18
BASE, STEP, SHORT = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit words."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


#: A word of 64 bits for each byte; A-Z share those of a-z.
BYTE_WORD = mix(np.arange(1, 257, dtype=U) * STEP)
BYTE_WORD[65:91] = BYTE_WORD[97:123]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers.get("up", ())) < n:
        n = 1 << max(18, (n - 1).bit_length())
        for name, base in (("up", int(BASE)), ("down", pow(int(BASE), -1, 1 << 64))):
            steps = np.full(n, base, U)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=U)
    return _powers["up"], _powers["down"]


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and their bounds; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), bounds


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of adjoining texts, and for each text the number of words before it."""
    n = len(data)
    space = IS_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[bounds[bounds <= n]] = True
    begins = np.flatnonzero(~space & (np.concatenate(([True], space[:-1])) | first[:n]))
    ends = np.flatnonzero(~space & (np.concatenate((space[1:], [True])) | first[1:])) + 1
    up, down = _power(n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum(BYTE_WORD[data] * up[:n], out=total[1:])
    words = mix((total[ends] - total[begins]) * down[begins] + (ends - begins).astype(U))
    return words, np.searchsorted(begins, bounds)


def chunks(bounds: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``most`` bytes together, or of one text."""
    at = 0
    while at < len(bounds) - 1:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, side="right")) - 1)
        yield at, end
        at = end


def shingle_sets(texts: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``size`` words.

    A text with fewer words has one shingle, its whole word sequence; one without words has none.
    """
    data, bounds = text_buffers(texts)
    for at, end in chunks(bounds):
        local = bounds[at : end + 1] - bounds[at]
        words, first = word_hashes(data[bounds[at] : bounds[end]], local)
        spans = len(words) - size + 1
        rolled = np.zeros(max(spans, 0), U)
        for k in range(size):
            rolled = rolled * STEP + words[k : k + len(rolled)]
        rolled = mix(rolled)
        for lo, hi in zip(first[:-1], first[1:], strict=True):
            if hi - lo >= size:
                got = np.sort(rolled[lo : hi - size + 1])
                yield got[np.concatenate(([True], got[1:] != got[:-1]))]
            elif hi > lo:
                one = np.array([hi - lo], U) * SHORT
                for k in range(lo, hi):
                    one = one * STEP + words[k : k + 1]
                yield mix(one)
            else:
                yield np.zeros(0, U)
