"""Languages of words and documents by a linear-chain conditional random field.

A word's features are its own hash, its affixes, its byte n-grams and what a lexicon says of it; a chain has learned weights
for the first label and for each pair of neighbours. Forward and backward sums give each word's odds, also in text that
changes language on the way; a document's language is the label with the largest sum of them.

Training takes a bounded sample of labelled documents, in one task that returns weights. Half of them give the lexicon, the
other half windows from anywhere in their texts, strung together so that languages change and transitions can be learned.
Chains of any length are cut into blocks of words: a block's product of matrices links what is before it to what is after,
so all blocks of all texts advance together, and no chain is longer than its document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import BASE, STEP, chunks, text_buffers, word_hashes

#: Languages (the most frequent ones), sampled documents of all together, and bytes of one of them, that training takes.
MAX_LANGUAGES, MAX_DOCS, MAX_BYTES = 64, 3000, 1 << 18
#: Entries of the lexicon: words of at least two sampled documents, most frequent first; share of a word's most likely language.
MAX_LEXICON, SHARES = 50_000, (0.95, 0.7)
BUCKETS, SEED = 1 << 17, 13
#: Words of a training chain and of its spans on average; chains of a step, steps, rate and decay of weights.
CHAIN, SPAN, BATCH, STEPS, RATE, DECAY = 48, 12, 32, 500, 0.4, 1e-5
#: Bytes of texts that are labelled together, and words of a block.
CHUNK, BLOCK = 1 << 20, 64
UNKNOWN = "und"
_U = np.uint64
#: ASCII other than letters parts words.
_PARTED = np.arange(256, dtype=np.uint8)
_PARTED[[b for b in range(128) if not chr(b).isalpha()]] = 0x20
SPANS = "array<struct<first:long,words:long,lang:string>>"


@dataclass(frozen=True)
class LanguageModel:
    """weights: of each bucket and language (bucket 0 holds nothing); lexicon: sorted word hashes and their feature."""

    languages: tuple[str, ...]
    weights: np.ndarray
    transitions: np.ndarray
    first: np.ndarray
    lexicon: np.ndarray
    known: np.ndarray


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes of texts in a row, where words begin and end, and each text's number of words before it."""
    data, bounds = text_buffers(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")))
    bounds = bounds - bounds[0]
    data = _PARTED[data[: bounds[-1]]]
    gap = data == 0x20
    start = np.zeros(len(data) + 1, bool)
    start[bounds] = True
    begins = np.flatnonzero(~gap & (np.concatenate(([True], gap[:-1])) | start[:-1]))
    ends = np.flatnonzero(~gap & (np.concatenate((gap[1:], [True])) | start[1:])) + 1
    return data, begins, ends, np.searchsorted(begins, bounds)


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    """A bucket from 1 on, by the top bits of a product."""
    return np.maximum((h * STEP + _U(kind * int(BASE) & (1 << 64) - 1)) >> _U(65 - BUCKETS.bit_length()), _U(1)).astype(np.int32)


def _features(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, hashes: np.ndarray, lexicon: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word its features that all words have (0: none), and the buckets of all n-grams with each word's first."""
    size = ends - begins
    padded = np.concatenate((data, np.full(4, 0x20, np.uint8))).astype(_U)
    fixed = [_bucket(hashes, 1)]
    at = np.clip(np.searchsorted(lexicon, hashes), 0, max(len(lexicon) - 1, 0))
    fixed.append(np.where(lexicon[at] == hashes, known[at], 1) if len(lexicon) else np.ones(len(hashes), np.int64))
    head, tail = np.zeros(len(size), _U), np.zeros(len(size), _U)
    for k in range(4):
        head = head << _U(8) | padded[begins + k]
        tail = tail | padded[np.maximum(ends - 1 - k, 0)] << _U(8 * k)
        fixed += [np.where(size > k, _bucket(head, 10 + k), 0), np.where(size > k, _bucket(tail, 20 + k), 0)]
    grams = size + 1  # pairs of bytes of a word between two spaces; as many triples from each on, but the last
    first = np.cumsum(grams) - grams
    # the words in a row, a space before each and two after the last
    at = np.arange(grams.sum()) + np.repeat(begins - first, grams)
    spaced = np.full(len(at) + 2, 0x20, _U)
    inner = np.ones(len(at), bool)
    inner[first + size] = False
    spaced[1:-1][inner] = padded[at[inner]]
    pairs = spaced[:-2] << _U(8) | spaced[1:-1]
    triples = np.where(inner, _bucket(pairs << _U(8) | spaced[2:], 31), 0)
    return np.stack(fixed, axis=1, dtype=np.int32, casting="unsafe"), np.stack((_bucket(pairs, 30), triples), axis=1, dtype=np.int32, casting="unsafe").ravel(), 2 * first


def _emissions(weights: np.ndarray, fixed: np.ndarray, grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    if not len(fixed):
        return np.zeros((0, weights.shape[1]))
    return (weights[fixed].sum(axis=1) + np.add.reduceat(weights[grams], first, axis=0)).astype(np.float64)


def posteriors(emissions: np.ndarray, bounds: np.ndarray, transitions: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each word's odds of each label. ``emissions``: log weights of the words of all chains; chain k is bounds[k] to bounds[k + 1]."""
    n, k = emissions.shape
    if not n:
        return emissions
    e = np.exp(emissions - emissions.max(axis=1, keepdims=True))
    step, start = np.exp(transitions - transitions.max()), np.exp(first - first.max())
    sizes = np.diff(bounds)
    blocks = -(-sizes // BLOCK)
    begins = np.repeat(bounds[:-1], blocks) + BLOCK * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    length = np.minimum(np.repeat(bounds[1:], blocks) - begins, BLOCK)
    opening = np.repeat(bounds[:-1], blocks) == begins
    at = np.minimum(begins[:, None] + np.arange(BLOCK), n - 1)
    steps = int(length.max())
    held = [e[at[:, t]] for t in range(steps)]  # of each block's word t
    inside = [(length > t)[:, None] for t in range(steps)]
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    # what each block makes of each state before it
    product = np.broadcast_to(np.eye(k), (len(begins), k, k)).copy()
    for t in range(steps):
        moved = (product.reshape(-1, k) @ step).reshape(-1, k, k)
        if t == 0:
            moved[opening] = start
        moved *= held[t][:, None, :]
        moved /= moved.max(axis=(1, 2), keepdims=True)
        product = np.where(inside[t][:, :, None], moved, product)
    # states before and after each block, along the chains
    entry, leave = np.full((len(begins), k), 1 / k), np.full((len(begins), k), 1 / k)
    low = np.cumsum(blocks) - blocks
    order = np.argsort(-blocks, kind="stable")
    chains = blocks[order]
    for j in range(1, int(blocks.max(initial=0))):
        now = order[: np.searchsorted(-chains, -j, side="left")]  # chains of more than j blocks
        b = low[now] + j
        entry[b] = norm(np.einsum("bi,bij->bj", entry[b - 1], product[b - 1]))
        b = low[now] + blocks[now] - j
        leave[b - 1] = norm(np.einsum("bij,bj->bi", product[b], leave[b]))
    ahead, now = [], entry
    for t in range(steps):
        moved = now @ step
        if t == 0:
            moved[opening] = start
        now = np.where(inside[t], norm(moved * held[t]), now)
        ahead.append(now)
    out, back = np.empty((n, k)), leave
    for t in range(steps - 1, -1, -1):
        ok = inside[t][:, 0]
        out[at[ok, t]] = norm(ahead[t][ok] * back[ok])
        back = np.where(inside[t], norm((held[t] * back) @ step.T), back)
    return out


def _lexicon(hashes: list[np.ndarray], labels: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of words that several documents have, and the feature of each: likeliest language and its share."""
    words = np.concatenate([np.unique(h) for h in hashes]) if hashes else np.zeros(0, _U)
    of = np.repeat(labels, [len(np.unique(h)) for h in hashes]) if hashes else labels
    distinct, at = np.unique(words, return_inverse=True)
    counts = np.zeros((len(distinct), k))
    np.add.at(counts, (at, of), 1)
    total = counts.sum(axis=1)
    keep = np.flatnonzero(total >= 2)
    keep = np.sort(keep[np.argsort(-total[keep], kind="stable")][:MAX_LEXICON])
    rate = counts[keep] / np.maximum(np.bincount(labels, minlength=k), 1)
    likely, share = rate.argmax(axis=1), rate.max(axis=1) / np.maximum(rate.sum(axis=1), 1e-12)
    level = sum((share < s).astype(np.int64) for s in SHARES)
    return distinct[keep], 2 + likely * (len(SHARES) + 1) + level


def fit_chain(texts: list[str], labels: np.ndarray, languages: tuple[str, ...], steps: int = STEPS) -> LanguageModel:
    """Stochastic gradient descent on the likelihood of chains made of labelled texts; no text gives a model without languages."""
    k, rng = len(languages), np.random.default_rng(SEED)
    data, begins, ends, bounds = _words(pa.array(texts, pa.string()))
    hashes, _ = word_hashes(data, np.append(np.append(0, ends[:-1]), len(data)) if len(ends) else np.array([0, len(data)]))
    has = np.flatnonzero(np.diff(bounds) > 0)
    lexical = has[::2] if len(has) > 1 else has
    lexicon, known = _lexicon([hashes[bounds[d] : bounds[d + 1]] for d in lexical], labels[lexical], max(k, 1))
    weights, transitions, first = np.zeros((BUCKETS, k), np.float32), np.zeros((k, k)), np.zeros(k)
    model = LanguageModel(languages, weights, transitions, first, lexicon, known)
    taught = has[1::2] if len(has) > 1 else has
    by_label = [taught[labels[taught] == x] for x in range(k)]
    # a language that only the lexicon's half has is taught from it
    by_label = [t if len(t) else has[labels[has] == x] for x, t in enumerate(by_label)]
    present = np.array([x for x, t in enumerate(by_label) if len(t)], np.int64)
    if not len(present):
        return model
    # features of each distinct word once
    _, one, which = np.unique(hashes, return_index=True, return_inverse=True)
    fixed, grams, at = _features(data, begins[one], ends[one], hashes[one], lexicon, known)
    many = np.diff(np.append(at, len(grams)))
    squares = np.full((BUCKETS, 1), 1e-2, np.float32)
    for step in range(steps):
        rate = RATE * (1 - step / steps)
        words, want = np.empty((BATCH, CHAIN), np.int64), np.empty((BATCH, CHAIN), np.int64)
        for chain in range(BATCH):
            done = 0
            while done < CHAIN:
                label = int(present[rng.integers(len(present))])
                doc = int(by_label[label][rng.integers(len(by_label[label]))])
                span = min(int(rng.geometric(1 / SPAN)), CHAIN - done, int(bounds[doc + 1] - bounds[doc]))
                begin = int(bounds[doc]) + int(rng.integers(bounds[doc + 1] - bounds[doc] - span + 1))
                words[chain, done : done + span] = np.arange(begin, begin + span)
                want[chain, done : done + span] = label
                done += span
        flat = which[words.ravel()]
        inner = np.repeat(at[flat] - (np.cumsum(many[flat]) - many[flat]), many[flat]) + np.arange(many[flat].sum())
        emitted = _emissions(weights, fixed[flat], grams[inner], np.cumsum(many[flat]) - many[flat])
        slope, moved, began = _gradient(emitted.reshape(BATCH, CHAIN, k), want, transitions, first)
        ids = np.concatenate((fixed[flat].ravel(), grams[inner]))
        push = np.concatenate((np.repeat(slope.reshape(-1, k), fixed.shape[1], axis=0), np.repeat(slope.reshape(-1, k), many[flat], axis=0))) / BATCH
        touched, where = np.unique(ids, return_inverse=True)
        total = np.stack([np.bincount(where, push[:, x], len(touched)) for x in range(k)], axis=1).astype(np.float32)
        squares[touched] += np.square(total).mean(axis=1, keepdims=True)
        weights[touched] = (1 - DECAY) * weights[touched] - rate * 0.25 * total / np.sqrt(squares[touched])
        weights[0] = 0
        transitions -= rate * moved / BATCH
        first -= rate * began / BATCH
    return model


def _gradient(emitted: np.ndarray, want: np.ndarray, transitions: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slopes of the negative log likelihood of chains of one length: of emissions, of transitions and of first labels."""
    chains, n, k = emitted.shape
    e = np.exp(emitted - emitted.max(axis=2, keepdims=True))
    step = np.exp(transitions)
    ahead, back = np.empty_like(e), np.empty_like(e)
    now = np.exp(first) * e[:, 0]
    for t in range(n):
        now = now if t == 0 else (now @ step) * e[:, t]
        ahead[:, t] = now = now / now.sum(axis=1, keepdims=True)
    back[:, -1] = now = np.ones((chains, k))
    for t in range(n - 2, -1, -1):
        now = (e[:, t + 1] * now) @ step.T
        back[:, t] = now = now / now.sum(axis=1, keepdims=True)
    odds = ahead * back
    odds /= odds.sum(axis=2, keepdims=True)
    both = ahead[:, :-1, :, None] * step * (e * back)[:, 1:, None, :]
    both /= both.sum(axis=(2, 3), keepdims=True)
    slope, moved, began = odds.copy(), both.sum(axis=(0, 1)), odds[:, 0].sum(axis=0)
    np.subtract.at(slope.reshape(-1, k), (np.arange(chains * n), want.ravel()), 1)
    np.subtract.at(moved, (want[:, :-1].ravel(), want[:, 1:].ravel()), 1)
    np.subtract.at(began, want[:, 0], 1)
    return slope, moved, began


def _fitted(languages: tuple[str, ...]):
    number = {x: n for n, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for batch in batches:
            texts += batch.column("text").to_pylist()
            labels += [number[x] for x in batch.column("lang").to_pylist()]
        m = fit_chain(texts, np.array(labels, np.int64), languages)
        parts = [m.weights.astype("<f4"), m.transitions.astype("<f8"), m.first.astype("<f8"), m.lexicon.astype("<u8"), m.known.astype("<i8")]
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], names=["weights", "transitions", "first", "lexicon", "known"])

    return run


def train_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """Fit on a bounded sample of ``docs``: as many of each of the MAX_LANGUAGES most frequent languages as there are, MAX_DOCS in all.

    The sample is that of the smallest hashes of keys. Rows without text, key or language teach nothing, nor do texts above
    MAX_BYTES; repeated rows count as often as they occur. Only counts of languages and the weights come to the driver.
    """
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"), docs[lang].cast("string").alias("lang"))
    rows = rows.filter(F.col("key").isNotNull() & (F.octet_length("text") <= MAX_BYTES) & F.col("lang").isNotNull())
    found = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    if not found:
        return fit_chain([], np.zeros(0, np.int64), ())
    languages = tuple(sorted(r["lang"] for r in found))
    place = F.pmod(F.xxhash64("key"), F.lit(1 << 40)) / float(1 << 40)
    share = F.lit(0.0)
    for r in found:
        share = F.when(F.col("lang") == r["lang"], F.lit(1.1 * MAX_DOCS / len(found) / r["count"])).otherwise(share)
    sampled = rows.withColumn("place", place).filter(F.col("place") < share).orderBy("place", "key", F.xxhash64("text"), "lang").limit(MAX_DOCS)
    made = sampled.select("text", "lang").repartition(1).mapInArrow(_fitted(languages), "weights binary, transitions binary, first binary, lexicon binary, known binary").first()
    if made is None:
        return fit_chain([], np.zeros(0, np.int64), ())
    k, of = len(languages), lambda name, kind: np.frombuffer(bytes(made[name]), kind)
    return LanguageModel(languages, of("weights", "<f4").reshape(-1, k), of("transitions", "<f8").reshape(k, k), of("first", "<f8"), of("lexicon", "<u8"), of("known", "<i8"))


def label_words(texts: pa.Array, model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Each word's odds of each language, and each text's number of words before it."""
    data, begins, ends, bounds = _words(texts)
    if not len(begins):
        return np.zeros((0, len(model.languages))), bounds
    hashes, _ = word_hashes(data, np.append(np.append(0, ends[:-1]), len(data)))
    _, one, which = np.unique(hashes, return_index=True, return_inverse=True)
    parts = _features(data, begins[one], ends[one], hashes[one], model.lexicon, model.known)
    return posteriors(_emissions(model.weights, *parts)[which], bounds, model.transitions, model.first), bounds


def _labelled(model: LanguageModel, key: pa.DataType, spans: bool):
    names = np.array([*model.languages, UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_string()).fill_null("")
            letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
            predicted, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            runs: list[list[dict]] = []
            _, all_bounds = text_buffers(texts)
            for at, end in chunks(all_bounds, CHUNK):
                if not model.languages:
                    runs += [[]] * (end - at)
                    continue
                odds, bounds = label_words(texts.slice(at, end - at), model)
                sums = np.concatenate((np.zeros((1, odds.shape[1])), np.cumsum(odds, axis=0)))
                mean = (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(np.diff(bounds), 1)[:, None]
                sure = letters[at:end]
                predicted[at:end] = np.where(sure, names[mean.argmax(axis=1)], UNKNOWN)
                score[at:end] = np.where(sure, np.clip(np.round(mean.max(axis=1), 6), 0, 1), 0)
                if spans:
                    labels = odds.argmax(axis=1)
                    change = np.ones(len(labels) + 1, bool)
                    change[1:-1] = labels[1:] != labels[:-1]
                    change[bounds] = True
                    begins = np.flatnonzero(change)
                    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                        own = begins[np.searchsorted(begins, low) : np.searchsorted(begins, high)].tolist()
                        runs.append([{"first": a - int(low), "words": b - a, "lang": names[labels[a]]} for a, b in zip(own, [*own[1:], int(high)])])
            columns = [batch.column("key").cast(key), pa.array(predicted, pa.string()), pa.array(score)]
            if spans:
                columns.append(pa.array(runs, pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(columns, names=["key", "lang_pred", "score", "spans"][: len(columns)])

    return run


def predict_languages(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text", spans: bool = False) -> DataFrame:
    """(key, lang_pred, score) for each row, with ``spans`` also the stretches of words of one language.

    score: the mean odds of that language over the text's words. Null texts, texts without a letter, and all texts if
    nothing was learned, have language ``und`` and score 0. Words are parted by white space and by ASCII other than letters.
    Texts of any length are labelled whole; equal texts get equal results; repeated rows and null keys are rows like others.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    kind = rows.schema["key"].dataType
    schema = f"key {kind.simpleString()}, lang_pred string, score double" + (f", spans {SPANS}" if spans else "")
    return rows.mapInArrow(_labelled(model, to_arrow_type(kind), spans), schema).withColumnRenamed("key", key)
