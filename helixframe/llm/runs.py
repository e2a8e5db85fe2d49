"""Periodic runs of words, by recompression.

Texts of a chunk become one sequence of word numbers, with a number of its own between texts. Block compression (a stretch
of one symbol becomes a symbol) and pair compression (a symbol of a left class and one of a right class after it become
one) take turns, until no symbol occurs twice: a run-length grammar whose rules depend on letters alone, so equal
stretches are parsed alike but for their ends. How far two places agree is then asked level by level: up while both begin a
phrase, over equal symbols, a whole block at once, and down again where symbols differ.

A run of period p and at least e periods holds a multiple of (e - 1) p with the place p later beside it. So places are
tried at multiples of (e - 1) p only, for each p: a harmonic grid of n log n pairs; the extensions both ways are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .shingles import chunks, text_buffers

#: Words that a run has at least, and periods.
LEAST, EXPONENT = 6, 4
#: Bytes of texts that share a grammar (or one longer text); pairs of places that are asked at once.
CHUNK, PAIRS = 1 << 21, 1 << 20
SEED = 11
RUNS = "array<struct<start:long,length:long,period:long>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


@dataclass(frozen=True)
class Level:
    """Symbols, and how they make those of the next level.

    up: the phrase that begins at a symbol, or -1, and one entry for the end; first: a phrase's first symbol, and the end.
    ahead, behind: symbols of the same block from here on and up to here; None where pairs are compressed.
    """

    symbols: np.ndarray
    up: np.ndarray | None = None
    first: np.ndarray | None = None
    ahead: np.ndarray | None = None
    behind: np.ndarray | None = None


def _level(symbols: np.ndarray, begins: np.ndarray, blocks: bool) -> Level:
    n = len(symbols)
    first = np.append(begins, n)
    up = np.full(n + 1, -1, np.int64)
    up[first] = np.arange(len(first))
    if not blocks:
        return Level(symbols, up, first)
    size = np.diff(first)
    place = np.arange(n) - np.repeat(begins, size)
    return Level(symbols, up, first, np.repeat(size, size) - place, place + 1)


def recompress(symbols: np.ndarray) -> list[Level]:
    """The grammar's levels, of numbers from 0 on without a gap; the last one's symbols are all different."""
    rng, levels = np.random.default_rng(SEED), []
    while True:
        n, kinds = len(symbols), int(symbols.max(initial=-1)) + 1
        if kinds == n:
            return [*levels, Level(symbols)]
        same = symbols[1:] == symbols[:-1]
        if same.any():
            begins = np.flatnonzero(np.concatenate(([True], ~same)))
            levels.append(_level(symbols, begins, True))
            symbols = pd.factorize((np.diff(np.append(begins, n)) - 1) * kinds + symbols[begins])[0].astype(np.int64)
            n, kinds = len(symbols), int(symbols.max()) + 1
        right = rng.random(kinds) < 0.5
        pair = np.append(~right[symbols[:-1]] & right[symbols[1:]], False)
        begins = np.flatnonzero(~np.concatenate(([False], pair[:-1])))
        levels.append(_level(symbols, begins, False))
        one, joined = symbols[begins], pair[begins]
        two = symbols[np.minimum(begins + 1, n - 1)]
        symbols = pd.factorize(np.where(joined, (one + 1) * kinds + two, one))[0].astype(np.int64)


def extension(levels: list[Level], a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
    """How many symbols agree from places ``a`` and ``b`` on (a <> b), or before them; the first and last symbol occur once."""
    shift, sign = (1, -1) if back else (0, 1)
    began, out = a, np.zeros(len(a), np.int64)
    held: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in levels]

    def over(level: Level, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if level.ahead is None:
            return np.full(len(a), sign)
        return -np.minimum(level.behind[a - 1], level.behind[b - 1]) if back else np.minimum(level.ahead[a], level.ahead[b])

    k, t = np.arange(len(a)), 0
    while len(k):
        level, risen = levels[t], []
        while len(k):
            equal = level.symbols[a - shift] == level.symbols[b - shift]
            held[t].append((k[~equal], a[~equal], b[~equal]))
            k, a, b = k[equal], a[equal], b[equal]
            if level.up is None or not len(k):
                step = over(level, a, b)
                a, b = a + step, b + step
                continue
            up_a, up_b = level.up[a], level.up[b]
            rise = (up_a >= 0) & (up_b >= 0)
            risen.append((k[rise], up_a[rise], up_b[rise]))
            k, a, b = k[~rise], a[~rise], b[~rise]
            step = over(level, a, b)
            a, b = a + step, b + step
        k, a, b = map(np.concatenate, zip(*risen)) if risen else (k, a, b)
        t += 1
    k = a = b = np.zeros(0, np.int64)
    for level, more in zip(levels[t - 1 :: -1], held[t - 1 :: -1], strict=True):
        if len(k):  # from the level above
            k, a, b = k, level.first[a], level.first[b]
        k, a, b = map(np.concatenate, zip((k, a, b), *more))
        moving = np.arange(len(k))
        a, b = a.copy(), b.copy()
        while len(moving):
            x, y = a[moving], b[moving]
            moving = moving[level.symbols[x - shift] == level.symbols[y - shift]]
            step = over(level, a[moving], b[moving])
            a[moving] += step
            b[moving] += step
    out[k] = sign * (a - began[k])
    return out


def find_runs(codes: list[np.ndarray], least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """(text, start, length, period) of the runs of each sequence of word numbers, in order of text, start and period.

    A run is a stretch of smallest period p, at least ``least`` and ``exponent`` p words long, that no neighbour extends.
    """
    if exponent < 2 or least < 3:
        raise ValueError("a run has two periods and three words at least")
    sizes = np.array([len(c) for c in codes], np.int64)
    kinds = max((int(c.max()) for c in codes if len(c)), default=-1) + 1
    parts = [x for k, c in enumerate(codes) for x in ([kinds + k], c)]
    symbols = pd.factorize(np.concatenate([*parts, [kinds + len(codes)]]).astype(np.int64))[0].astype(np.int64)
    levels, offsets = None, np.cumsum(sizes + 1) - sizes
    most = np.where(sizes >= least, sizes // exponent, 0)
    text = np.repeat(np.arange(len(codes)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    places = (sizes[text] - period - 1) // ((exponent - 1) * period) + 1
    until, found, at = np.cumsum(places), [], 0
    while at < len(text):
        end = max(at + 1, int(np.searchsorted(until, (until[at - 1] if at else 0) + PAIRS, side="right")))
        many = places[at:end]
        p = np.repeat(period[at:end], many)
        x = (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)) * (exponent - 1) * p
        d = np.repeat(text[at:end], many)
        x += offsets[d]
        agree = symbols[x] == symbols[x + p]
        # one of the neighbours agrees as well, unless a run is as short as a period and a word
        agree &= (symbols[x - 1] == symbols[x + p - 1]) | (symbols[x + 1] == symbols[np.minimum(x + p + 1, len(symbols) - 1)]) | (np.maximum(least, exponent * p) - p < 2)
        x, p, d = x[agree], p[agree], d[agree]
        at = end
        if not len(x):
            continue
        levels = levels or recompress(symbols)
        before, after = extension(levels, x, x + p, back=True), extension(levels, x, x + p)
        length = before + after + p
        long = length >= np.maximum(least, exponent * p)
        found.append(np.stack([d, x - before - offsets[d], length, p])[:, long])
    d, start, length, p = np.concatenate([np.zeros((4, 0), np.int64), *found], axis=1)
    order = np.lexsort((p, length, start, d))
    rows = np.stack([d, start, length, p], axis=1)[order]
    # a stretch's smallest period comes first; its multiples are no periods of a run
    rows = rows[np.concatenate(([True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)))[: len(rows)]]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _collapsed(least: int, exponent: int, key: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_buffers(batch.column("text"))
            runs, kept = [], []
            for at, end in chunks(bounds, CHUNK):
                texts = [data[bounds[k] : bounds[k + 1]].tobytes().split() for k in range(at, end)]
                numbers: dict[bytes, int] = {}
                codes = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)) for words in texts]
                found = find_runs(codes, least, exponent)
                cut = np.searchsorted(found[:, 0], np.arange(len(texts) + 1))
                for words, low, high in zip(texts, cut[:-1], cut[1:], strict=True):
                    own = found[low:high, 1:]
                    runs.append([{"start": s, "length": n, "period": p} for s, n, p in own.tolist()])
                    if len(own):
                        drop = np.zeros(len(words) + 1, np.int64)
                        np.add.at(drop, own[:, 0] + own[:, 2], 1)
                        np.add.at(drop, own[:, 0] + own[:, 1], -1)
                        words = compress(words, (np.cumsum(drop) == 0).tolist())
                    kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column("key").cast(key), pa.array(runs, _RUNS), pa.array(kept, pa.large_string() if sum(map(len, kept)) > 1 << 28 else pa.string())], names=["key", "runs", "collapsed"])

    return run


def collapse_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """(key, runs, collapsed) for each row: its runs of words, and its text with each run cut to its first period.

    Words are what white space (0x20, 0x09-0x0D) separates, and are joined by one space. A run is a stretch of smallest
    period p of at least ``least`` words and ``exponent`` periods that no neighbouring word extends; a word goes if any
    run holds it after that run's first p words. Runs are in order of start and period.

    Null and empty texts have no run and an empty text; repeated rows and null keys are rows like others, whatever else
    the table holds. A text is one value, so it is worked on by one task, with some 200 bytes of memory for each word.
    """
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    kind = rows.schema["key"].dataType
    out = rows.mapInArrow(_collapsed(least, exponent, _arrow(kind)), f"key {kind.simpleString()}, runs {RUNS}, collapsed string")
    return out.withColumnRenamed("key", key)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
