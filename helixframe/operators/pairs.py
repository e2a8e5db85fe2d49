"""Substitution counts of all ordered pairs, their symmetric sums, distances and coverages."""

from __future__ import annotations

import mmap
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import models
from ..functions.draws import multinomial
from ..functions.numerics import c_div
from ..functions.thresholds import P_VALUE, anchor_threshold
from ..sources.shared import written
from .anchors import IN_MEMORY, OVERLAP, Query, State, Subject, room, walk, walk_block
from .lanes import walk_lanes
from .sequences import subjects

PAIRS = "subject_id long, query_id long, counts array<long>, seq_len long"
WALKS = "subject_id long, query_id long, block int, counts array<long>, seq_len long, began string, ended string"
ARROW = pa.schema([("subject_id", pa.int64()), ("query_id", pa.int64()), ("block", pa.int32()), ("counts", pa.list_(pa.int64())), ("seq_len", pa.int64()), ("began", pa.string()), ("ended", pa.string())])
#: Letters of a block of subjects, and of a block of queries; partitions that blocks are dealt to.
BLOCK, QUERY_BLOCK, MOST_TASKS = 1 << 23, 1 << 25, 10_000
#: Letters before a block of a query by which its first state is guessed; letters from which a query is walked by lanes.
LEAD, LONG = 4096, 1 << 15
#: Rows of a task, in this order.
STATE, QUERY, SUBJECT = 0, 1, 2
_UNPACKED = np.frombuffer(b"ACGT!", np.uint8).take(np.stack((np.arange(256) >> 4, np.arange(256) & 15), axis=1), mode="clip")
_COMPLEMENT = np.full(256, ord(";"), np.uint8)
_COMPLEMENT[list(b"ACGT")] = list(b"TGCA")


def _packed(letters: Column) -> Column:
    """Symbols A C G T ! at two to a byte; an odd number has a zero before it."""
    return F.unhex(F.translate(letters, "ACGT!", "01234"))


class _Pieces:
    """The packed pieces of a batch: letters that are copied to their places."""

    def __init__(self, column: pa.Array):
        kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
        _, offsets, data = column.buffers()
        self.offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].tolist() if len(column) else [0]
        self.data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)

    def copy(self, row: int, size: int, out: np.ndarray, at: int) -> None:
        if size:
            out[at : at + size] = _UNPACKED[self.data[self.offsets[row] : self.offsets[row + 1]]].reshape(-1)[-size:]


def _opened(size: int, before: int = 0) -> tuple[bytearray | mmap.mmap, np.ndarray]:
    """Room for symbols that come in pieces, ! where none does, after as many others; and the view that they are copied to."""
    space = room(before + size)
    view = np.frombuffer(space, np.uint8)[before:] if before + size else np.zeros(0, np.uint8)
    view[:] = ord("!")
    return space, view


def _both_strands(space: bytearray | mmap.mmap, n: int) -> None:
    """Puts a sequence's other strand and # before it, as ``both_strands``."""
    out = np.frombuffer(space, np.uint8)
    for at in range(0, n, IN_MEMORY):
        to = min(at + IN_MEMORY, n)
        out[at:to] = _COMPLEMENT[out[2 * n + 1 - to : 2 * n + 1 - at][::-1]]
    out[n] = ord("#")


def _thresholds(pieces: DataFrame, sizes: DataFrame, p_value: float) -> DataFrame:
    """(seq_id, len, threshold) of sequences; null for one without symbols."""
    gc = pieces.groupBy("seq_id").agg(F.sum(F.regexp_count("seq", F.lit("[GC]"))).alias("gc"))
    rows = sizes.select("seq_id", F.col("len").cast("long").alias("len")).join(gc, "seq_id", "left")
    share = c_div(F.coalesce("gc", F.lit(0)), F.col("len"))
    return rows.select("seq_id", "len", anchor_threshold(share, 2 * F.col("len") + 1, p_value).alias("threshold"))


def _blocks(pieces: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """(query, block, rank, at, piece, n): pieces cut for blocks of queries, each with the LEAD before it and the OVERLAP after it."""
    rows = pieces.join(sizes.select("seq_id", F.col("len").cast("long").alias("n"), "rank"), "seq_id")
    end = F.col("place") + F.length("seq")
    first = F.greatest(F.col("place") - OVERLAP, F.lit(0)).cast("long")
    last = F.greatest(F.least(end + LEAD, F.col("n")) - 1, F.lit(0)).cast("long")
    rows = rows.withColumn("block", F.explode(F.sequence(F.expr("0L") + F.floor(first / block), F.floor(last / block))))
    low = F.greatest(F.col("block") * block - LEAD, F.col("place"))
    high = F.least((F.col("block") + 1) * block + OVERLAP, end)
    piece = F.substring("seq", (low - F.col("place") + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int"))
    return rows.select(F.col("seq_id").alias("query"), F.col("block").cast("int").alias("block"), "rank", low.alias("at"), piece.alias("piece"), "n")


def _ranked(sizes: DataFrame) -> DataFrame:
    """Sizes with a rank, the longest first: blocks that are dealt by it are of like sizes."""
    return sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("len").desc(), "seq_id")) - 1)


def piece_counts(
    pieces: DataFrame, sizes: DataFrame, model: str = "jc", p_value: float = P_VALUE, subject_blocks: int | None = None, query_blocks: int | None = None,
    queries: tuple[DataFrame, DataFrame] | None = None, block: int = QUERY_BLOCK,
) -> DataFrame:
    """(subject_id, query_id, counts, seq_len) for each ordered pair of different sequences, which come in pieces.

    ``pieces``: (seq_id, place, seq), for a sequence without symbols one row; ``sizes``: (seq_id, len); ``queries``: others
    to compare them with. Subjects and queries are dealt into blocks, and a task compares one block of each: every subject
    is sent to ``query_blocks`` tasks and every query to ``subject_blocks``. A task reads its rows as a stream, keeps long
    sequences in files that go with it, and indexes its subjects one after the other. By default there are at least 64 blocks
    of subjects, if there are as many, or as many as hold BLOCK letters each.

    A query of more than ``block`` letters is walked in blocks by different tasks. Where a block's walk begins depends on
    the one before: it is guessed first, by a walk of the letters before it, and blocks whose guess was wrong are walked
    again from where the one before ended, until all agree. The first block is right at once, and a wrong guess seldom
    reaches the next block's end.
    """
    fourths = models.model_name(model) in models.BY_FOURTHS
    known = written(_ranked(_thresholds(pieces, sizes, p_value)), "thresholds")
    others, other_sizes = (pieces, known) if queries is None else (queries[0], written(_ranked(queries[1].select("seq_id", "len")), "sizes"))
    of = lambda rows: rows.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0)), F.coalesce(F.max("len"), F.lit(0))).first()
    n, letters, _ = of(known)
    m, query_letters, longest = of(other_sizes)
    subject_blocks = subject_blocks or max(1, min(n, max(64, -(-letters // BLOCK))))
    # small ones are dealt to enough tasks all the same
    query_blocks = query_blocks or max(1, min(m + query_letters // block, max(-(-query_letters // block), -(-40 // subject_blocks))))
    dealt = lambda of, rank: F.pmod(rank, F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    none = lambda kind: F.lit(None).cast(kind)
    number = lambda x: F.lit(x).cast("long")
    left = pieces.join(known, "seq_id").select(
        dealt(subject_blocks, F.col("rank")).alias("sb"), F.lit(SUBJECT).alias("kind"), F.col("seq_id").alias("id"), F.lit(0).alias("block"), F.col("place").alias("at"), _packed(F.col("seq")).alias("piece"),
        F.length("seq").alias("size"), F.col("len").alias("n"), "threshold", none("long").alias("subject"), none("string").alias("state"),
    )
    right = _blocks(others, other_sizes, block).select(
        dealt(query_blocks, F.col("rank") + F.col("block")).alias("qb"), F.lit(QUERY).alias("kind"), F.col("query").alias("id"), "block", "at", _packed(F.col("piece")).alias("piece"),
        F.length("piece").alias("size"), "n", none("int").alias("threshold"), none("long").alias("subject"), none("string").alias("state"),
    )
    columns = ["sb", "qb", "kind", "id", "block", "at", "piece", "size", "n", "threshold", "subject", "state"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, now, states, found, subject = None, None, {}, [], None

        def counted() -> list[tuple]:
            """Rows of the subject that has been read, and all blocks of queries of its group."""
            if subject is None:
                return []
            sid, space, _, total, threshold = subject
            out, index = [], None
            for q, k, text, _, n in found:
                if q == sid or states and (sid, q, k) not in states:
                    continue
                if index is None and threshold is not None:
                    _both_strands(space, total)
                    index = Subject(space, threshold)
                low, high = k * block, min(n, (k + 1) * block)
                state, counts, after = states.get((sid, q, k)), [0] * 16, State()
                if index is not None:
                    lead = min(low, LEAD)
                    if state is None:
                        state = walk_block(index, Query(bytes(text[: lead + OVERLAP]), low - lead, low, n), fourths, State(pos=low - lead))[1] if lead else State()
                    body = Query(text[lead:] if lead else text, low, high, n)
                    counts, after = (walk_lanes if high - low >= LONG else walk_block)(index, body, fourths, state)
                out.append((sid, q, k, [int(x) for x in counts], n, (state or after).to_json(), after.to_json()))
            return out

        def rows(out: list[tuple]) -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), ARROW.types)], schema=ARROW)

        for batch in batches:
            packed = _Pieces(batch.column("piece"))
            for row, (sb, qb, kind, name, k, at, size, n, threshold, of, state) in enumerate(zip(*(batch.column(c).to_pylist() for c in columns if c != "piece"))):
                if (sb, qb) != group:
                    yield from rows(counted())
                    group, now, states, found, subject = (sb, qb), None, {}, [], None
                if kind == STATE:
                    states[of, name, k] = State.from_json(state)
                    continue
                if (kind, name, k) != now:
                    now = (kind, name, k)
                    if kind == QUERY:
                        low, high = max(0, k * block - LEAD), min(n, (k + 1) * block + OVERLAP)
                        text, view = _opened(high - low)
                        found.append((name, k, text, low, n))
                    else:
                        yield from rows(counted())
                        low, (space, view) = 0, _opened(n, n + 1)
                        subject = (name, space, view, n, threshold)
                packed.copy(row, size, view, at - low)
        yield from rows(counted())

    def walked(asked: DataFrame | None = None) -> DataFrame:
        if asked is None:
            rows = left.withColumn("qb", every(query_blocks)).select(columns).unionByName(right.withColumn("sb", every(subject_blocks)).select(columns))
        else:
            ranks = known.select(F.col("seq_id").alias("subject"), dealt(subject_blocks, F.col("rank")).alias("sb"))
            places = other_sizes.select(F.col("seq_id").alias("query"), F.col("rank").alias("of"))
            where = asked.join(ranks, "subject").join(places, "query").withColumn("qb", dealt(query_blocks, F.col("of") + F.col("block")))
            rows = left.join(where.select(F.col("subject").alias("id"), "qb").distinct(), "id").select(columns)
            rows = rows.unionByName(right.join(where.select(F.col("query").alias("id"), "block", "sb").distinct(), ["id", "block"]).select(columns))
            states = where.select(
                "sb", "qb", F.lit(STATE).alias("kind"), F.col("query").alias("id"), "block", number(0).alias("at"), none("binary").alias("piece"), F.lit(0).alias("size"), number(0).alias("n"), none("int").alias("threshold"), "subject", "state",
            )
            rows = rows.unionByName(states.select(columns))
        # as many groups as there are tasks to fill: none is left to share one with another by chance
        rows = rows.repartition(min(4 * subject_blocks * query_blocks, MOST_TASKS), "sb", "qb").sortWithinPartitions("sb", "qb", "kind", "id", "block", "at")
        return rows.mapInArrow(run, WALKS)

    found = walked()
    if longest > block:
        found = _settled(found, walked)
        sums = [F.sum(F.col("counts")[k]).alias(f"c{k}") for k in range(16)]
        found = found.groupBy("subject_id", "query_id").agg(*sums, F.max("seq_len").alias("seq_len"))
        found = found.withColumn("counts", F.array(*(f"c{k}" for k in range(16))))
    return found.select("subject_id", "query_id", "counts", "seq_len")


def _settled(found: DataFrame, again) -> DataFrame:
    """Walks of blocks, each of which began where the one before it ended; ``again`` walks (subject, query, block, state)."""
    now = written(found, "walks")
    while True:
        before = F.lag("ended").over(Window.partitionBy("subject_id", "query_id").orderBy("block"))
        moved = now.select("subject_id", "query_id", "block", "began", before.alias("state")).filter("state <> began")
        moved = written(moved.select(F.col("subject_id").alias("subject"), F.col("query_id").alias("query"), "block", "state"), "moved")
        if moved.isEmpty():
            return now
        keys = moved.select(F.col("subject").alias("subject_id"), F.col("query").alias("query_id"), "block")
        now = written(now.join(keys, ["subject_id", "query_id", "block"], "left_anti").unionByName(again(moved)), "walks")


def in_pieces(sequences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pieces, sizes) of sequences (seq_id, seq, len) that are one value each."""
    return sequences.select("seq_id", F.lit(0).cast("long").alias("place"), "seq"), sequences.select("seq_id", "len")


def pair_counts(sequences: DataFrame, model: str = "jc", p_value: float = P_VALUE, subject_blocks: int | None = None, query_blocks: int | None = None, queries: DataFrame | None = None) -> DataFrame:
    """``piece_counts`` of sequences (seq_id, seq, len) that are one value each; ``queries``: others to compare them with."""
    return piece_counts(*in_pieces(sequences), model, p_value, subject_blocks, query_blocks, in_pieces(queries) if queries is not None else None)


def symmetric(pairs: DataFrame) -> DataFrame:
    """(i, j, counts, seq_len) with i < j: the cell-by-cell sums of both directions."""
    sums = [F.sum(F.col("counts")[k]).alias(f"c{k}") for k in range(16)]
    rows = pairs.groupBy(F.least("subject_id", "query_id").alias("i"), F.greatest("subject_id", "query_id").alias("j")).agg(*sums, F.sum("seq_len").alias("seq_len"))
    return rows.select("i", "j", F.array(*(f"c{k}" for k in range(16))).alias("counts"), "seq_len")


def distances(pairs: DataFrame, model: str = "jc", average: bool = True) -> DataFrame:
    """(i, j, distance) for i <> j: of the summed counts both ways, or with ``average=False`` of each direction's own."""
    if not average:
        return pairs.select(F.col("subject_id").alias("i"), F.col("query_id").alias("j"), models.distance(model, F.col("counts")).alias("distance"))
    once = symmetric(pairs).withColumn("distance", models.distance(model, F.col("counts")))
    return once.select(F.explode(F.array(F.struct("i", "j", "distance"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "distance"))).alias("x")).select("x.*")


def coverages(pairs: DataFrame) -> DataFrame:
    """(subject_id, query_id, coverage): compared letters over the query's length."""
    return pairs.select("subject_id", "query_id", models.coverage(F.col("counts"), F.col("seq_len")).alias("coverage"))


def bootstrap(pairs: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """(replicate, i, j, counts, seq_len): multinomial draws from each pair's summed counts, replicates from 1.

    ``replicates`` counts the matrix of the data itself, so one less is drawn. Draws repeat for a seed; a pair without
    counts draws none. Both directions of a replicate carry the drawn counts, so a consumer that adds them doubles them.
    """
    if replicates < 1:
        raise ValueError("replicates must be 1 or more")
    rows = symmetric(pairs)
    rows = rows.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates - 1)))) if replicates > 1 else rows.withColumn("replicate", F.lit(1)).filter(F.lit(False))
    key = F.concat_ws("/", F.lit(str(seed)), "replicate", "i", "j")
    return rows.select("replicate", "i", "j", multinomial(F.col("counts"), key).alias("counts"), "seq_len")


def pair_counts_within(sequences: DataFrame, key: str, model: str = "jc", p_value: float = P_VALUE) -> DataFrame:
    """Like ``pair_counts``, but only among the sequences of one ``key`` (a pair or a small family), which meet in one task."""
    fourths = models.model_name(model) in models.BY_FOURTHS

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for sid, rs, threshold in zip(pdf["seq_id"], pdf["rs"], pdf["threshold"], strict=True):
            index = None if pd.isna(threshold) else Subject(rs, int(threshold))
            for k, qid, q in zip(pdf[key], pdf["seq_id"], pdf["seq"], strict=True):
                if qid != sid:
                    rows.append((k, sid, qid, walk(index, q, fourths) if index else [0] * 16, len(q)))
        return pd.DataFrame(rows, columns=[key, "subject_id", "query_id", "counts", "seq_len"])

    rows = subjects(sequences, p_value).select(key, "seq_id", "seq", "rs", "threshold")
    return rows.groupBy(key).applyInPandas(run, f"{key} long, {PAIRS}")
