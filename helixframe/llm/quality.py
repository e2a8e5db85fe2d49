"""Quality classifier: supervised subword embeddings.

Words, word pairs and character 4-grams are hashed into one table of learned vectors. A document is the mean of its
features' vectors, and a softmax layer gives the probability of label 1. Both are trained by numpy stochastic gradient
descent on a bounded sample of labelled documents, by one task that returns the weights. As the layer is linear in the
mean, scoring needs one number a feature; these are kept as integers, so a score doesn't depend on how documents are
batched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import slices
from .shingles import IS_SPACE, STEP, chunks, mix, text_buffers, word_hashes

BUCKETS, DIM, EPOCHS, RATE, SEED = 1 << 17, 16, 6, 2.0, 7
#: Labelled documents that training reads at most: those with the smallest hash of their id. As many distinct features
#: of all of them together; a document beyond it, whole, isn't read.
MAX_LABELLED, MAX_FEATURES = 6000, 1 << 25
#: One in the integer scale of a feature's weight.
UNIT = 1 << 20


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32)


def _features(texts: pa.Array) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """For a run of texts: the buckets of each kind of feature, and the bounds of each text in them."""
    data, bounds = text_buffers(texts)
    for at, end in chunks(bounds):
        local = bounds[at : end + 1] - bounds[at]
        part = data[bounds[at] : bounds[end]]
        words, first = word_hashes(part, local)
        # a pair is kept at its first word, unless that is its text's last
        inside = np.ones(len(words), bool)
        inside[(first[1:] - 1)[first[1:] > 0]] = False
        at_pair = np.flatnonzero(inside)
        one, two = words[at_pair], words[np.minimum(at_pair + 1, len(words) - 1)]
        # a word that stands twice in a row is the same feature for all words
        pairs = mix(np.where(one == two, STEP, one * STEP + two))
        wide = part.astype(np.uint64)
        grams = wide[:-3] | wide[1:-2] << np.uint64(8) | wide[2:-1] << np.uint64(16) | wide[3:] << np.uint64(24) if len(part) > 3 else wide[:0]
        space = IS_SPACE[part]
        keep = ~(space[1:-2] | space[2:-1]) if len(part) > 3 else np.zeros(0, bool)
        for b in local[1:-1]:
            keep[max(b - 3, 0) : b] = False
        at_gram = np.flatnonzero(keep)
        yield [
            (_bucket(words), first),
            (_bucket(pairs), np.searchsorted(at_pair, first)),
            (_bucket(mix(grams[at_gram] + STEP)), np.searchsorted(at_gram, local)),
        ]


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, quality, buckets (little-endian, 4 bytes each) and counts (the fewest bytes that hold them all) of each document."""
    for batch in (part for whole in batches for part in slices(whole)):
        ids, counts = [], []
        for kinds in _features(batch.column("text")):
            for i in range(len(kinds[0][1]) - 1):
                x, n = np.unique(np.concatenate([b[f[i] : f[i + 1]] for b, f in kinds]), return_counts=True)
                ids.append(x.astype("<i4").tobytes())
                counts.append(n.astype(np.min_scalar_type(n.max(initial=0)).newbyteorder("<")).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("quality").cast(pa.int32()), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "quality", "ids", "counts"])


def _unpacked(ids: pa.Scalar, counts: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts that ``_sparse`` wrote, as views of the batch that holds them."""
    i, c = ids.as_buffer(), counts.as_buffer()
    i = np.frombuffer(i, "<i4") if i.size else np.zeros(0, "<i4")
    return i, np.frombuffer(c, f"<u{c.size // len(i)}") if len(i) else np.zeros(0, "<u1")


@dataclass(frozen=True)
class QualityModel:
    """weights: the log odds of label 1 that each bucket adds to the mean, times UNIT; bias: in log odds."""

    weights: np.ndarray
    bias: float


def fit_vectors(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> QualityModel:
    """Stochastic gradient descent over (buckets, counts, label); no rows give the model that always says one half."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = rng.normal(0, 1 / DIM, (2, DIM)).astype(np.float32), np.zeros(2, np.float32)
    if not rows:
        out[:] = 0
    total, done = epochs * len(rows), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            ids, counts, label = rows[k]
            step = rate * (1 - done / total)
            done += 1
            share = (counts / max(counts.sum(), 1)).astype(np.float32)
            mean = share @ vectors[ids]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = p @ out
            out -= step * 0.1 * np.outer(p, mean)
            bias -= step * 0.02 * p
            vectors[ids] -= (step * 5) * np.outer(share / np.sqrt(np.square(share).sum() + 1e-12) * 0.2, back)
    weights = np.rint((vectors @ (out[1] - out[0])).astype(np.float64) * UNIT).astype(np.int32)
    return QualityModel(weights, float(bias[1] - bias[0]))


def _fitted(most: int):
    """One row, the weights and the bias, from a task's sparse documents in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = [], 0
        for batch in batches:
            for i, c, q in zip(batch.column("ids"), batch.column("counts"), batch.column("quality").to_pylist(), strict=True):
                ids, counts = _unpacked(i, c)
                total += len(ids)
                if total > most:
                    break
                rows.append((ids, counts, int(q > 0)))
        model = fit_vectors(rows)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.astype("<i4").tobytes()], pa.binary()), pa.array([model.bias], pa.float64())], names=["weights", "bias"])

    return run


def train_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED, max_features: int = MAX_FEATURES) -> QualityModel:
    """Fit on at most ``max_rows`` rows of ``labels`` (doc_id, quality) and their whole texts.

    Labels that are null or contradict each other count as none and as their minimum; rows that repeat a labelled
    document count as often as they occur. Only the weights come to the driver.
    """
    chosen = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # max_rows bounds what is sent to all executors, and what one task reads
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(_sparse, "doc_id long, quality int, ids binary, counts binary")
    ordered = found.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", F.xxhash64("ids", "counts"))
    made = ordered.mapInArrow(_fitted(max_features), "weights binary, bias double").first()
    if made is None:
        return fit_vectors([])
    return QualityModel(np.frombuffer(made["weights"], "<i4"), made["bias"])


def _scored(model: QualityModel, name: str):
    weights, bias = model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            odds = []
            for kinds in _features(batch.column("text")):
                total, n = np.zeros(len(kinds[0][1]) - 1, np.int64), np.zeros(len(kinds[0][1]) - 1, np.int64)
                for b, f in kinds:
                    at = np.concatenate(([0], np.cumsum(weights[b], dtype=np.int64)))
                    total += at[f[1:]] - at[f[:-1]]
                    n += f[1:] - f[:-1]
                odds.append(total / np.maximum(n, 1) / UNIT + bias)
            score = 1 / (1 + np.exp(-np.concatenate(odds))) if odds else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*batch.schema.names, name])

    return run


def score_quality(docs: DataFrame, model: QualityModel, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``, the probability of label 1 (an own column of that name is replaced).

    Equal texts get equal scores. Null and empty texts have no feature and get the model's prior.
    """
    docs = docs.drop(name)
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    return docs.mapInArrow(_scored(model, name), schema)
