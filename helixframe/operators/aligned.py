"""Substitution counts of sequences that are compared place by place."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..functions.sequence import CELLS

#: Places that are compared in one task, and genomes of a block of them.
CHUNK, GENOMES = 1 << 16, 32
_CODE = np.full(256, -1, np.int8)
_CODE[list(b"ACGT")] = np.arange(4)


def _codes(letters: str | None) -> np.ndarray:
    return _CODE[np.frombuffer((letters or "").encode(), np.uint8)]


def _cells(s: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The 16 cells of two runs of letter codes; symbols below A count nowhere."""
    real = (s >= 0) & (q >= 0)
    return np.bincount(4 * s[real] + q[real], minlength=16)


def mutation_counts(rows: DataFrame, keys: list[str], subject: str, query: str) -> DataFrame:
    """Counts for each ``keys`` of two string columns aligned from their first letter on, as far as both go.

    Rows without letters on either side add nothing; a key that has no others gets zeros.
    """

    def run(subject: pd.Series, query: pd.Series) -> pd.Series:
        found = []
        for s, q in zip(map(_codes, subject), map(_codes, query), strict=True):
            n = min(len(s), len(q))
            found.append(_cells(s[:n], q[:n]))
        return pd.Series(found)

    counted = rows.select(*keys, F.pandas_udf(run, ArrayType(LongType()))(subject, query).alias("c"))
    return counted.groupBy(*keys).agg(F.array(*(F.sum(F.col("c")[k]) for k in range(len(CELLS)))).alias("counts"))


def _chunk(pdf: pd.DataFrame) -> pd.DataFrame:
    """Counts of the ordered pairs between two blocks of genomes (or within one), over the places of a chunk.

    One matrix product of planes, each of which marks a genome's places of one letter, has the cells of all pairs.
    """
    low, high = pdf["low"].iloc[0], pdf["high"].iloc[0]
    letters: dict[int, np.ndarray] = {}
    blocks: dict[int, int] = {}
    for g, block, at, piece in zip(pdf["seq_id"], pdf["block"], pdf["at"], pdf["piece"], strict=True):
        blocks[g] = block
        codes = _codes(piece)
        letters.setdefault(g, np.full(CHUNK, -1, np.int8))[at : at + len(codes)] = codes
    sides = [[g for g in letters if blocks[g] == block] for block in ((low,) if low == high else (low, high))]
    # 4 planes of each genome; a float32 holds every count of a chunk exactly
    planes = [(np.stack([letters[g] for g in side])[:, None, :] == np.arange(4)[:, None]).reshape(-1, CHUNK).astype(np.float32) if side else np.zeros((0, CHUNK), np.float32) for side in sides]
    cells = (planes[0] @ planes[-1].T).astype(np.int64).reshape(len(sides[0]), 4, len(sides[-1]), 4).transpose(0, 2, 1, 3)
    rows = []
    for x, a in enumerate(sides[0]):
        for y, b in enumerate(sides[-1]):
            if low != high:
                rows += [(a, b, cells[x, y].ravel()), (b, a, cells[x, y].T.ravel())]
            elif a != b:
                rows.append((a, b, cells[x, y].ravel()))
    return pd.DataFrame(rows, columns=["subject_id", "query_id", "counts"])


def aligned_pairs(pieces: DataFrame, genomes: DataFrame) -> DataFrame:
    """(subject_id, query_id, counts, seq_len) of all ordered pairs of ``genomes`` (seq_id, len), aligned from their first place on.

    ``pieces``: (seq_id, place, seq), the letters of a genome from some place on. They are cut at multiples of CHUNK, and
    the genomes' letters of one chunk meet in one task, or in several that each take two blocks of genomes.
    """
    first, last = F.expr(f"place div {CHUNK}"), F.expr(f"(place + length(seq) - 1) div {CHUNK}")
    cut = pieces.filter("length(seq) > 0").select("*", F.explode(F.sequence(first, last)).alias("chunk"))
    begin = F.greatest(F.col("chunk") * CHUNK, F.col("place"))
    piece = F.substring("seq", (begin - F.col("place") + 1).cast("int"), (F.least((F.col("chunk") + 1) * CHUNK, F.col("place") + F.length("seq")) - begin).cast("int"))
    n = max(1, -(-genomes.count() // GENOMES))
    cut = cut.select("seq_id", "chunk", (begin % CHUNK).cast("int").alias("at"), piece.alias("piece"), F.pmod(F.xxhash64("seq_id"), F.lit(n)).cast("int").alias("block"))
    others = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other")
    cut = cut.select("*", others).select("seq_id", "chunk", "at", "piece", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    counted = cut.groupBy("chunk", "low", "high").applyInPandas(_chunk, "subject_id long, query_id long, counts array<long>")
    counted = counted.groupBy("subject_id", "query_id").agg(F.array(*(F.sum(F.col("counts")[k]) for k in range(len(CELLS)))).alias("counts"))
    ids = genomes.select(F.col("seq_id").alias("subject_id"))
    lengths = genomes.select(F.col("seq_id").alias("query_id"), F.col("len").alias("seq_len"))
    every = ids.join(lengths, F.col("subject_id") != F.col("query_id"))
    none = F.array(*(F.lit(0).cast("long") for _ in CELLS))
    return every.join(counted, ["subject_id", "query_id"], "left").select("subject_id", "query_id", F.coalesce("counts", none).alias("counts"), "seq_len")
