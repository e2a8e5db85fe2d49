"""Packing token sequences: best-two-fit, and best-fit-decreasing into id matrices.

Both deal their pieces out evenly over the whole corpus and pack them in large blocks, so that file layout does not matter.
Best-two-fit deals light rows of lengths; matrices hold the ids themselves, so there the ids are dealt, two bytes each.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_materialized, materialize
from .tokens import default_vocabulary, token_ids

CAPACITY, END_ID = 1024, 2
#: Pieces that best-two-fit chooses from at once, and tokens of a block of matrices.
BLOCK_PIECES, BLOCK_TOKENS = 1_000_000, 1 << 22
#: Pieces of the whole corpus that are dealt to one task of best-two-fit, and text bytes to one task of matrices.
MIXED_PIECES, MIXED_BYTES = 1 << 16, 24 << 20
#: Sequences in a stored matrix.
MATRIX_ROWS = 64


def best_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices whose lengths (1 to ``capacity``) sum to ``capacity`` at most.

    Each bin is filled greedily, the longest that fits first. If it has a gap, its smallest item makes way for two
    unpacked items whenever some pair fills the expanded gap more tightly.
    """
    stock: dict[int, list[int]] = defaultdict(list)
    for i in reversed(range(len(lengths))):
        stock[lengths[i]].append(i)
    there = sum(1 << n for n in stock)  # bit n: an item of length n is left

    def take(n: int) -> int:
        nonlocal there
        i = stock[n].pop()
        if not stock[n]:
            there &= ~(1 << n)
        return i

    bins = []
    while there:
        now, gap = [], capacity
        while fit := there & ((2 << gap) - 1) & ~1:
            n = fit.bit_length() - 1
            now.append(take(n))
            gap -= n
        if gap and there:
            small = lengths[now[-1]]
            room, best, pair = gap + small, small, None
            left = there & ((2 << (room // 2)) - 1)
            while left and best < room:
                b = (left & -left).bit_length() - 1
                left &= left - 1
                fit = there & ((2 << (room - b)) - 1)
                if len(stock[b]) < 2:
                    fit &= ~(1 << b)
                a = fit.bit_length() - 1
                if a >= b and a + b > best:
                    best, pair = a + b, (a, b)
            if pair:
                back = now.pop()
                now += [take(n) for n in pair]
                stock[small].append(back)
                there |= 1 << small
        bins.append(now)
    return bins


class CapacityTree:
    """A segment tree over the room that open bins have left: finds the least room that still fits."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: dict[int, list[int]] = defaultdict(list)

    def add(self, room: int, b: int) -> None:
        self.bins[room].append(b)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        k = room + self.size
        while k:
            self.count[k] += by
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, bin) of a bin with the least room of at least ``need``, removed; None if there is none."""
        k = need + self.size
        while not self.count[k]:
            while k & 1:  # a right child: go on above
                k >>= 1
                if not k:
                    return None
            k += 1
        while k < self.size:
            k = 2 * k if self.count[2 * k] else 2 * k + 1
        room = k - self.size
        self._change(room, -1)
        return room, self.bins[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices, the longest items first, each into the fullest bin that still has room."""
    tree, bins = CapacityTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        if found := tree.take(lengths[i]):
            room, b = found
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room - lengths[i]:
            tree.add(room - lengths[i], b)
    return bins


def pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document of n ids: whole, or cut into pieces of ``capacity``, the first maybe shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))] if n else []


def _documents(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[int | None, np.ndarray]]:
    end = np.array([end_id], np.uint32)
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            yield doc_id, np.concatenate((token_ids(text.as_py(), path), end))


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECE}, sequence_id long, offset long, filled boolean"


def _cut(path: str, capacity: int, end_id: int):
    kinds = dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc_id, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for doc_id, ids in _documents(iter([batch]), path, end_id) for k, (s, n) in enumerate(pieces(len(ids), capacity))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

    return run


def _packed(capacity: int, block: int, first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, total = first + (TaskContext.get().partitionId() << 33), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal at, total
            rows = pa.Table.from_batches(held).combine_chunks()
            lengths = rows.column("length").to_pylist()
            sequence, offset, filled = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), bool)
            for b in best_two_fit(lengths, capacity):
                place = 0
                for i in b:
                    sequence[i], offset[i] = at, place
                    place += lengths[i]
                filled[b] = place == capacity
                at += 1
            held.clear()
            total = 0
            for name, values in (("sequence_id", sequence), ("offset", offset), ("filled", filled)):
                rows = rows.append_column(name, pa.array(values))
            yield from rows.to_batches(max_chunksize=10_000)

        for batch in batches:
            held.append(batch)
            total += batch.num_rows
            if total >= block:
                yield from flush()
        if total:
            yield from flush()

    return run


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, block: int = BLOCK_PIECES, mix: int = MIXED_PIECES) -> DataFrame:
    """Best-two-fit of all rows of ``docs`` (doc_id, text): one row for each piece, with its sequence and place.

    Only the pieces' names and lengths are dealt out, evenly, into blocks of about ``mix`` from the whole corpus, so that
    file layout does not matter. The pieces of all sequences that are not full are then packed once more in the same way.
    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts are packed as their end
    id alone; repeated rows are packed as often as they occur, rows without doc_id like others; other columns are left
    aside, whatever their names; an empty table gives no piece.
    """
    light = materialize(docs.select("doc_id", "text").mapInArrow(_cut(vocabulary or default_vocabulary(), capacity, end_id), PIECE), "pieces")
    deal = lambda rows: rows.repartition(max(1, -(-rows.count() // mix)))
    once = materialize(deal(light).mapInArrow(_packed(capacity, block, 0), PLACED), "packed")
    drop_materialized(light)
    # written too: a task that ran anew could get its rows in another order, and pack them otherwise
    again = materialize(deal(once.filter("not filled").select(light.columns)).mapInArrow(_packed(capacity, block, 1 << 61), PLACED), "again")
    return once.filter("filled").unionByName(again).drop("filled")


MATRICES = "matrix_id long, n_rows int, width int, ids binary, cu_seqlens array<array<int>>, position_resets array<int>, doc_ids array<array<long>>, pieces array<array<int>>"


def _id_pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for doc_id, ids in _documents(iter([batch]), path, end_id):
                if ids.max() > 0xFFFF:
                    raise ValueError(f"token id {ids.max()} doesn't fit 16 bits")
                held += [(doc_id, k, ids[s : s + n].astype("<u2").tobytes()) for k, (s, n) in enumerate(pieces(len(ids), capacity))]
            for lo in range(0, len(held), 10_000):
                doc_ids, numbers, ids = zip(*held[lo : lo + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(ids, pa.binary())], names=["doc_id", "piece", "ids"])

    return run


def _matrices(capacity: int, pad_id: int, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, total = TaskContext.get().partitionId() << 33, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal at
            bins = best_fit_decreasing([len(x) for _, _, x in held], capacity)
            for lo in range(0, len(bins), MATRIX_ROWS):
                part = bins[lo : lo + MATRIX_ROWS]
                ids = np.full((len(part), capacity), pad_id, "<u2")
                ends, resets = [], []
                for r, b in enumerate(part):
                    end = [0]
                    for i in b:
                        resets.append(r * capacity + end[-1])
                        ids[r, end[-1] : end[-1] + len(held[i][2])] = held[i][2]
                        end.append(end[-1] + len(held[i][2]))
                    if end[-1] < capacity:  # padding counts positions of its own
                        resets.append(r * capacity + end[-1])
                    ends.append(end)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([at], pa.int64()), pa.array([len(part)], pa.int32()), pa.array([capacity], pa.int32()), pa.array([ids.tobytes()], pa.binary()),
                        pa.array([ends], pa.list_(pa.list_(pa.int32()))), pa.array([resets], pa.list_(pa.int32())),
                        pa.array([[[held[i][0] for i in b] for b in part]], pa.list_(pa.list_(pa.int64()))), pa.array([[[held[i][1] for i in b] for b in part]], pa.list_(pa.list_(pa.int32()))),
                    ],
                    names=["matrix_id", "n_rows", "width", "ids", "cu_seqlens", "position_resets", "doc_ids", "pieces"],
                )
                at += 1
            held.clear()

        for batch in batches:
            for doc_id, k, ids in zip(batch.column("doc_id").to_pylist(), batch.column("piece").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                held.append((doc_id, k, np.frombuffer(ids, "<u2")))
                total += len(held[-1][2])
                if total >= block_tokens:
                    yield from flush()
                    total = 0
        if held:
            yield from flush()

    return run


def packed_matrices(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = 50256, pad_id: int = 50256, block_tokens: int = BLOCK_TOKENS, mix: int = MIXED_BYTES) -> DataFrame:
    """Best-fit-decreasing of all rows of ``docs`` into matrices of token ids (uint16, little-endian, row by row).

    Pieces of all documents are dealt out evenly, about ``mix`` bytes of text to a task, which packs them in blocks of
    ``block_tokens``: the number of sequences does not depend on how the rows were stored. Write the result before it is
    read twice, as pieces can be dealt otherwise the next time.
    A row is a matrix of up to 64 sequences: its ids, for each sequence the cumulative segment lengths, and the places
    in the flattened matrix where position ids start again from 0 (padding has positions of its own). doc_ids and pieces
    name the segments. A document of more than ``capacity`` ids is cut into pieces, none of which loses an id.
    Null and empty texts are one end id; repeated rows and rows without doc_id are packed like others; an id above 65,535
    raises; an empty table gives no matrix.
    """
    if not 0 <= pad_id <= 0xFFFF:
        raise ValueError(f"token id {pad_id} doesn't fit 16 bits")
    docs = docs.select("doc_id", "text")
    tasks = max(1, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // mix))
    dealt = docs.mapInArrow(_id_pieces(vocabulary or default_vocabulary(), capacity, end_id), "doc_id long, piece int, ids binary").repartition(tasks)
    return dealt.mapInArrow(_matrices(capacity, pad_id, block_tokens), MATRICES)


def _read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for m in batch.to_pylist():
            ids = np.frombuffer(m["ids"], "<u2").reshape(m["n_rows"], m["width"])
            resets, width = np.array(m["position_resets"]), m["width"]
            starts = np.searchsorted(resets, np.arange(m["n_rows"] + 1) * width)
            n = m["n_rows"]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([m["matrix_id"] * MATRIX_ROWS + r for r in range(n)], pa.int64()),
                    pa.array([c[-1] for c in m["cu_seqlens"]], pa.int32()),
                    pa.array(m["cu_seqlens"], pa.list_(pa.int32())),
                    pa.array([(resets[starts[r] : starts[r + 1]] - r * width).tolist() for r in range(n)], pa.list_(pa.int32())),
                    pa.array(m["doc_ids"], pa.list_(pa.int64())),
                    pa.array(m["pieces"], pa.list_(pa.int32())),
                    pa.array([[zlib.crc32(ids[r, a:b].astype("<u4").tobytes()) for a, b in zip(c[:-1], c[1:], strict=True)] for r, c in enumerate(m["cu_seqlens"])], pa.list_(pa.int64())),
                ],
                names=["sequence_id", "n_tokens", "cu_seqlens", "position_resets", "doc_ids", "pieces", "ids_crc32"],
            )


def stored_sequences(matrices: DataFrame) -> DataFrame:
    """One row for each sequence of matrices that were written: what its stored ids and segments say."""
    return matrices.mapInArrow(_read_rows, "sequence_id long, n_tokens int, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, pieces array<int>, ids_crc32 array<long>")


def write_matrices(docs: DataFrame, path: str, **options) -> DataFrame:
    """Write the packed matrices of ``docs`` as Parquet and return the written table."""
    spark = docs.sparkSession
    made = packed_matrices(docs, **options)
    made.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(made.schema).parquet(path)
