"""Improbable-feature digests of documents.

Each window of 32 bytes has an entropy; windows of a rare entropy are improbable. The rarity of each entropy level is
counted over all documents. Among any 32 neighbouring windows the rarest is marked, and windows marked often enough are
the features. Features go in order into a chain of Bloom filters of 2048 bits, 160 in each, and two digests are compared
by the bits that their filters share beyond what chance gives.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import STEP, chunks, mix, text_buffers

WINDOW, NEIGHBOURS, MARKS = 32, 32, 8
LEVELS = 1024
BITS, PER_FILTER, HASHES = 2048, 160, 5
#: Bytes handled at a time; features that begin there may read on.
SPAN = 1 << 19
#: Rows and bytes of text of a part of neighbouring documents, and the most parts that ids are cut into.
PART_ROWS, PART_BYTES, MOST_PARTS = 2000, 16 << 20, 20_000

_counts = np.arange(WINDOW + 1)
#: c * log2(c) in whole units, for exact sums.
_CLOG = np.rint(np.where(_counts > 0, _counts * np.log2(np.maximum(_counts, 1)), 0) * (1 << 16)).astype(np.int64)
_GAIN = np.append(np.diff(_CLOG), 0)
_WEIGHTS = mix(np.arange(1, WINDOW + 1, dtype=np.uint64) * STEP) | np.uint64(1)


def entropy_levels(x: np.ndarray) -> np.ndarray:
    """Entropy of each window of 32 bytes of ``x``, as a level from 0 to LEVELS - 1."""
    n = len(x) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.int16)
    # how often a byte is among the 31 before it, and among the 31 after it
    before, after = np.zeros(len(x), np.uint8), np.zeros(len(x), np.uint8)
    for k in range(1, WINDOW):
        same = (x[k:] == x[:-k]).view(np.uint8)
        before[k:] += same
        after[:-k] += same
    first = _CLOG[np.bincount(x[:WINDOW], minlength=256)].sum()
    change = _GAIN[before[WINDOW:]] - _GAIN[after[: n - 1]]
    total = np.concatenate(([first], first + np.cumsum(change)))
    bits = np.log2(WINDOW) - total / (WINDOW * (1 << 16))
    return np.clip(bits / np.log2(WINDOW) * (LEVELS - 1), 0, LEVELS - 1).astype(np.int16)


def _levels(x: np.ndarray) -> np.ndarray:
    """``entropy_levels`` of a text of any length, a span at a time."""
    return np.concatenate([entropy_levels(x[at : at + SPAN + WINDOW - 1]) for at in range(0, max(len(x) - WINDOW + 1, 1), SPAN)])


def _level_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(LEVELS, np.int64)
    for batch in batches:
        data, bounds = text_buffers(batch.column(0))
        for at, end in chunks(bounds, SPAN):
            part = data[bounds[at] : bounds[end]]
            inside = np.ones(max(len(part) - WINDOW + 1, 0), bool)
            for b in bounds[at + 1 : end] - bounds[at]:
                inside[max(b - WINDOW + 1, 0) : b] = False  # windows over two texts
            if len(inside):
                counts += np.bincount(_levels(part)[inside], minlength=LEVELS)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["level", "n"])


def fit_rarity(docs: DataFrame) -> np.ndarray:
    """Rank of each entropy level, 0 the rarest, by the windows of all texts; unseen levels are ordered by themselves."""
    rows = docs.select("text").mapInArrow(_level_counts, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()  # at most LEVELS
    counts = np.zeros(LEVELS, np.int64)
    for r in rows:
        counts[r["level"]] = r["n"]
    order = np.lexsort((np.arange(LEVELS), counts))
    rank = np.empty(LEVELS, np.int64)
    rank[order] = np.arange(LEVELS)
    return rank


def _rarest_marks(rank: np.ndarray) -> np.ndarray:
    """How many runs of NEIGHBOURS windows each window is the rarest of (the leftmost of ties)."""
    n = len(rank)
    key = rank * (1 << 32) + np.arange(n)
    width = 1
    while width * 2 <= min(NEIGHBOURS, n):
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    rest = min(NEIGHBOURS, n) - width
    if rest:
        key = np.minimum(key[:-rest], key[rest:])
    return np.bincount(key & 0xFFFFFFFF, minlength=n)


def _features(ranks: np.ndarray) -> np.ndarray:
    """Places of the improbable windows among all windows of a text; at least one."""
    marks = _rarest_marks(ranks)
    chosen = np.flatnonzero(marks >= MARKS)
    return chosen if len(chosen) else np.array([int(marks.argmax())])


def digests(texts: list[np.ndarray], rank: np.ndarray) -> list[np.ndarray]:
    """The chain of Bloom filters of each text (its UTF-8 bytes), as bits: (filters, BITS).

    A text below 32 bytes is padded with zeros to one window; an empty text has no filter.
    """
    made = []
    sizes = np.array([max(len(x), WINDOW) if len(x) else 0 for x in texts], np.int64)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    for at, end in chunks(bounds, SPAN):
        part = np.concatenate([np.pad(x, (0, n - len(x))) if n > len(x) else x for x, n in zip(texts[at:end], sizes[at:end], strict=True)])
        ranks = rank[_levels(part)] if len(part) else None
        own = bounds[at : end + 1] - bounds[at]
        places = [_features(ranks[a : b - WINDOW + 1]) + a if b > a else np.zeros(0, np.int64) for a, b in zip(own[:-1], own[1:], strict=True)]
        every = np.concatenate(places)
        hashes = np.zeros(len(every), np.uint64)
        for k in range(WINDOW):
            hashes += part[every + k] * _WEIGHTS[k]
        hashes = mix(hashes)
        for h in np.split(hashes, np.cumsum([len(p) for p in places])[:-1]):
            # a feature that a text repeats counts once, in its first place
            h = h[np.sort(np.unique(h, return_index=True)[1])]
            bits = np.zeros((-(-len(h) // PER_FILTER), BITS), bool)
            which = np.arange(len(h)) // PER_FILTER
            for k in range(HASHES):
                bits[which, (h >> np.uint64(11 * k)).astype(np.int64) & (BITS - 1)] = True
            made.append(bits)
    return made


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: each filter of the shorter chain against the best of the other, by shared bits beyond chance.

    Two empty texts are alike (1), an empty and another are not (0).
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    na, nb = a.sum(1, dtype=np.int64), b.sum(1, dtype=np.int64)
    shared = (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    chance, most = np.outer(na, nb) / BITS, np.minimum.outer(na, nb)
    score = np.clip((shared - chance) / np.maximum(most - chance, 1e-9), 0, 1)
    return float(np.average(score.max(1), weights=na))


def _encoded(bits: np.ndarray) -> str:
    return base64.b64encode(np.packbits(bits, axis=1).tobytes()).decode()


def decoded(text: str) -> np.ndarray:
    """The bits of a fingerprint string."""
    return np.unpackbits(np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, BITS // 8), axis=1).astype(bool)


def fingerprints(docs: DataFrame, rank: np.ndarray) -> DataFrame:
    """(doc_id, fingerprint) for each row of ``docs``; equal texts get equal ones, null and empty texts an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_buffers(batch.column("text"))
            made = [_encoded(x) for x in digests([data[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], rank)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def edited_text(text: str, following: str) -> str:
    """``text`` with its last third replaced by the first as many code points of ``following``, or all of it."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(rank: np.ndarray):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None  # the row before: its part, id, text and filters
        for whole in frames:
            for lo in range(0, len(whole), 200):
                pdf = whole.iloc[lo : lo + 200]
                rows = [(at, None if pd.isna(i) else int(i), t or "", bool(g)) for at, i, t, g in zip(pdf["at"], pdf["doc_id"], pdf["text"], pdf["guest"], strict=True)]
                pairs, before = [], last and (*last[:3], False)  # a document and the one after it, by place in ``rows``; -1: the row before
                for k, r in enumerate(rows):
                    if before is not None and not before[3] and before[0] == r[0]:
                        pairs.append((k - 1, k))
                    before = r
                texts = [r[2] for r in rows] + [edited_text(rows[a][2] if a >= 0 else last[2], rows[b][2]) for a, b in pairs]
                bits = digests([np.frombuffer(t.encode(), np.uint8) for t in texts], rank)
                out = []
                for (a, b), text, of_edited in zip(pairs, texts[len(rows) :], bits[len(rows) :], strict=True):
                    doc, own = (rows[a], bits[a]) if a >= 0 else (last, last[3])
                    out.append((doc[1], len(doc[2]), sha256(text.encode()).hexdigest(), _encoded(own), _encoded(of_edited), similarity(own, of_edited), similarity(own, bits[b])))
                last = None if rows[-1][3] else (*rows[-1][:3], bits[len(rows) - 1])
                if out:
                    made = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
                    yield made.astype({"doc_id": "Int64"})

    return run


def compare_with_next(docs: DataFrame, rank: np.ndarray, rows_per_part: int = PART_ROWS, bytes_per_part: int = PART_BYTES) -> DataFrame:
    """Each document against its edited text and the next document, by descending doc_id; after the last comes the first.

    Rows that share a doc_id follow each other by text; rows without id come last, by a hash of their text, and equal
    texts follow each other. One document alone is its own next; an empty table gives none. Texts are shuffled once: parts
    are ranges of doc_id of like bytes, or of hashes for rows without id, and a part's last row finds its next in a copy
    of the following part's first row. Tasks read their parts as a stream, so a part may exceed memory.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named, size = F.col("doc_id").isNotNull(), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    sizes = {r["named"]: r for r in docs.groupBy(named.alias("named")).agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).collect()}
    if not sizes:
        return docs.sparkSession.createDataFrame([], EDITED)
    wanted = lambda r: min(MOST_PARTS, max(-(-r["n"] // rows_per_part), -(-r["bytes"] // bytes_per_part)))
    parts, spare = (wanted(sizes[k]) if k in sizes else 0 for k in (True, False))
    cuts = []
    if parts > 1:
        # an id stands once, and once more for each such stretch of its text: some more rows than there are ids
        stretch = max(1, sizes[True]["bytes"] // (4 * parts))
        weighed = docs.filter(named).select(F.explode(F.array_repeat("doc_id", (1 + F.floor(size / stretch)).cast("int"))).alias("doc_id"))
        cuts = sorted(set(weighed.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts)))
    # part 0 has the largest ids; ids above the last cut, then between cuts, ...; one number for each part
    bounds = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def part_of(doc_id: pd.Series) -> pd.Series:
        return pd.Series((len(bounds) - np.searchsorted(bounds, doc_id.to_numpy(np.int64))).astype(np.int32))

    # rows without id: ranges of hashes, all alike, so nothing has to be counted
    hashed = F.when(~named, F.xxhash64("text"))
    slot = F.least(F.floor((hashed / F.lit(2.0**64) + 0.5) * spare), F.lit(max(spare - 1, 0)))
    at = F.when(named, part_of(F.coalesce("doc_id", F.lit(0)))).otherwise((slot + len(cuts) + 1).cast("int"))
    placed = docs.withColumn("h", hashed).withColumn("at", at)
    heads = placed.groupBy("at").agg(F.max("doc_id").alias("id"), F.min("h").alias("h")).orderBy("at").collect()  # one for each part
    # a part's first document is also a guest of the part before it; the key is its id, or its hash

    def guests(rows: DataFrame, key: str, known: list[tuple[int, int]]) -> DataFrame:
        firsts, hosts = np.array(sorted(known), np.int64).reshape(-1, 2).T

        @F.pandas_udf("int")
        def host_of(value: pd.Series) -> pd.Series:
            x = value.to_numpy(np.int64)
            k = np.minimum(np.searchsorted(firsts, x), len(firsts) - 1)
            return pd.Series(np.where(firsts[k] == x, hosts[k], -1).astype(np.int32))

        return rows.withColumn("at", host_of(key)).filter("at >= 0")

    before = [(r, heads[k - 1]["at"]) for k, r in enumerate(heads)]
    every = guests(placed.filter(named), "doc_id", [(r["id"], host) for r, host in before if r["id"] is not None]) if parts else None
    if spare:
        # of equal texts one is enough
        others = guests(placed.filter(~named), "h", [(r["h"], host) for r, host in before if r["id"] is None]).dropDuplicates(["h", "text"])
        every = others if every is None else every.unionByName(others)
    both = placed.withColumn("guest", F.lit(False)).unionByName(every.withColumn("guest", F.lit(True)))
    order = [F.col("doc_id").desc_nulls_last(), "h", F.col("text").asc_nulls_first()]
    dealt = both.repartitionById(len(cuts) + 1 + spare, "at").sortWithinPartitions("at", "guest", *order)
    return dealt.select("at", "doc_id", "text", "guest").mapInPandas(_compared(rank), EDITED)
