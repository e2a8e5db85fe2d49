"""Texts as media columns: each payload is stored as a lossless WebP picture and read back from the stored bytes.

A payload's bytes are the green samples of a picture 576 wide, so that the padded payload fills whole rows. Passages
that occur again become back-references, payloads of few distinct bytes a palette of packed indices, and payloads whose
steps from byte to byte tell less than the bytes do are predicted from the left. (Cross-colour and a colour cache can gain
nothing where one channel alone carries samples; the decoder reads both.)
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import materialize
from .shingles import STEP, mix
from .webp import PALETTE, PREDICTOR, decode, encode, encode_green

ROW, SIDE, PAD = 576, 16384, 255
#: Most bytes of one picture, and the mode of a predictor that repeats the sample on the left: fixed values.
LARGEST, LEFT = SIDE // ROW * ROW * SIDE, 1
#: Bytes of a window that finds repeats, least repeat worth a back-reference, and the format's longest one.
SEEK, LEAST, MOST = 32, 64, 4096
_RAW = mix(np.arange(257, 513, dtype=np.uint64) * STEP) | np.uint64(1)


def repeats(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, distance) of long passages of ``x`` that stand before, apart from each other and in order."""
    n = len(x) - SEEK + 1
    if n < SEEK:
        return []
    # a sum over the window that starts at each place
    width, part, factor = 1, _RAW.take(x), int(STEP)
    while width < SEEK:  # windows of 1, 2, 4, ... bytes
        part = part[:-width] * np.uint64(factor) + part[width:]
        factor = factor * factor & 0xFFFFFFFFFFFFFFFF
        width *= 2
    hashes = mix(part)
    places = (hashes < np.uint64(1 << 59)).nonzero()[0]
    kept = hashes[places].tolist()
    if len(set(kept)) == len(kept):
        return []
    found, seen, covered = [], {}, 0
    for i, h in zip(places.tolist(), kept, strict=True):
        j = seen.get(h)
        seen[h] = i
        if j is None or i < covered:
            continue
        distance, begin = i - j, i
        while begin > covered and begin > distance and i - begin < SEEK and x[begin - 1] == x[begin - 1 - distance]:
            begin -= 1
        same = x[begin : begin + MOST] == x[begin - distance : begin - distance + min(MOST, len(x) - begin)]
        length = len(same) if same.all() else int(same.argmin())
        if length >= LEAST:
            found.append((begin, length, distance))
            covered = begin + length
    return found


def _bits(counts: np.ndarray) -> float:
    """The entropy of bytes that occur so often, in bits for all of them."""
    n = counts[counts > 0]
    return float(-(n * np.log2(n / n.sum())).sum())


def _one_picture(payload: bytes) -> bytes:
    rows = len(payload) // ROW
    across = -(-rows // SIDE)
    x = np.frombuffer(payload + bytes([PAD]) * ((-rows % across) * ROW), np.uint8)
    counts, steps = np.bincount(x, minlength=256), np.bincount(x[1:] - x[:-1], minlength=256)
    steps[0] += 1  # the first sample has none before it
    few = np.count_nonzero(counts) <= 16
    if not few and _bits(steps) >= 0.95 * _bits(counts):
        return encode_green(x.reshape(-1, ROW * across), repeats(x))
    argb = (x.astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000)).reshape(-1, ROW * across)
    if few:
        return encode(argb, transforms=[(PALETTE,)])
    modes = np.full((-(-argb.shape[0] // 512), -(-argb.shape[1] // 512)), LEFT)
    return encode(argb, transforms=[(PREDICTOR, 9, modes)])


def to_picture(payload: bytes) -> bytes:
    """A payload, a positive multiple of 576 bytes, as a lossless WebP file, or as several in a row above LARGEST bytes."""
    return b"".join(_one_picture(payload[at : at + LARGEST]) for at in range(0, len(payload), LARGEST))


def from_picture(media: bytes, payload_bytes: int) -> np.ndarray:
    """The payload's bytes again, read from one file after the other."""
    parts, at, left = [], 0, payload_bytes
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        n = min(left, LARGEST)
        parts.append((decode(media[at : at + size]).reshape(-1)[:n] >> np.uint32(8)).astype(np.uint8))
        at, left = at + size, left - n
    return np.concatenate(parts)


def picture_feature(x: np.ndarray) -> str:
    """Shares of 16 brightness bands and the bits of 64 spans above the mean, in hexadecimal."""
    bands = np.bincount(x >> 4, minlength=16) * 255 // len(x)
    means = x.reshape(64, -1).sum(1, dtype=np.int64)
    return bands.astype(np.uint8).tobytes().hex() + np.packbits(means * 64 > means.sum()).tobytes().hex()


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            sizes, padded, media = [], [], []
            for text in part.column("text"):
                raw = (text.as_py() or "").encode()
                payload = raw + bytes([PAD]) * (ROW if not raw else -len(raw) % ROW)
                sizes.append(len(raw))
                padded.append(len(payload))
                media.append(to_picture(payload))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(padded, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "payload_bytes", "media"])


def store_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, media), written to the shared folder, for each row of ``docs`` (doc_id, text).

    A text's UTF-8 is padded with bytes 255 to a positive multiple of 576; null counts as empty. Equal texts give equal
    media; repeated rows are stored again; a text of any length is stored whole, and a row without doc_id like others.
    """
    return materialize(docs.select("doc_id", "text").mapInArrow(_stored, "doc_id long, n_bytes long, payload_bytes long, media binary"), "media")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    for batch in batches:
        rows = []
        for media, size in zip(batch.column("media"), batch.column("payload_bytes").to_pylist(), strict=True):
            media = media.as_py()
            x = from_picture(media, size)
            rows.append((sha256(x.tobytes()).hexdigest(), zlib.crc32(x[-32:].tobytes()), len(media), sha256(media).hexdigest(), picture_feature(x)))
        if rows:
            made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_bytes", "payload_bytes")), *made], names=["doc_id", "n_bytes", "payload_bytes", *names])


def read_media(stored: DataFrame) -> DataFrame:
    """What the stored pictures of ``store_media`` say: digests of the payload read back and of the media, a feature."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.mapInArrow(_read, schema)
