"""Media columns: lossless 8-bit grey PNG in a binary column, read back by checksum, numpy unfiltering and cosine hashes.

The PNG reader handles all five filter types of 8-bit grey images without interlace; the writer
chooses none, sub or up for each row, by the smallest sum of absolute differences.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duovox.llm.common import ready, text_or_empty

#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
SIDE, KEPT, SCALE = 32, 8, 1 << 12
#: Low-frequency rows of the cosine transform as integers: products stay below 2^53, so float sums are exact in any order.
COSINES = np.rint(SCALE * np.cos(np.pi * (2 * np.arange(SIDE) + 1) * np.arange(KEPT)[:, None] / (2 * SIDE)))
FEATURE_TYPE = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def write_png(samples: np.ndarray, level: int = 6) -> bytes:
    """A grey image of shape (height, width), uint8, as PNG."""
    height, width = samples.shape
    left, above = np.zeros_like(samples), np.zeros_like(samples)
    left[:, 1:], above[1:] = samples[:, :-1], samples[:-1]
    ways = np.stack([samples, samples - left, samples - above])
    cost = np.minimum(ways, -ways).sum(axis=2, dtype=np.int64)
    kinds = cost.argmin(axis=0)
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0] = kinds
    rows[:, 1:] = ways[kinds, np.arange(height)]
    header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undo the row filters. None and sub need no other row; a run of up rows is one cumulative sum."""
    out = rows.copy()
    sub = kinds == 1
    out[sub] = np.cumsum(rows[sub], axis=1, dtype=np.uint8)
    cuts = np.flatnonzero(np.diff(kinds)) + 1
    for first, last in zip(np.r_[0, cuts], np.r_[cuts, len(kinds)]):
        kind = kinds[first]
        before = out[first - 1] if first else np.zeros(rows.shape[1], np.uint8)
        if kind == 2:
            out[first:last] = np.cumsum(rows[first:last], axis=0, dtype=np.uint8) + before
        elif kind in (3, 4):
            for y in range(first, last):
                up = out[y - 1] if y else before
                row, a, c = rows[y].tolist(), 0, 0
                for x, b in enumerate(up.tolist()):
                    if kind == 3:
                        guess = (a + b) // 2
                    else:
                        p = a + b - c
                        pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                        guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                    a, c = (row[x] + guess) & 255, b
                    row[x] = a
                out[y] = row
        elif kind > 4:
            raise ValueError(f"unknown PNG filter {kind}")
    return out


def read_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit grey PNG. A wrong signature, checksum, length or kind raises ValueError."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, shape, parts, ended = 8, None, [], False
    while at < len(data) and not ended:
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or data[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(body, zlib.crc32(kind))):
            raise ValueError(f"PNG chunk {kind!r} fails its checksum")
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", body)
            if rest != [8, 0, 0, 0, 0]:
                raise ValueError("only 8-bit grey PNG without interlace is read")
            shape = height, width
        elif kind == b"IDAT":
            parts.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if not ended or shape is None:
        raise ValueError("PNG ends early")
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(shape[0], shape[1] + 1)
    return _unfilter(rows[:, 0], rows[:, 1:])


def thumbnail(samples: np.ndarray) -> np.ndarray:
    """SIDE x SIDE whole-number means (times 16) of an image that is WIDTH wide; short images repeat rows."""
    height = len(samples)
    pairs = samples.astype(np.int64).reshape(height, SIDE, -1).sum(axis=2)
    at = np.arange(SIDE) * height // SIDE
    if height < SIDE:
        return pairs[at] * 16 // (WIDTH // SIDE)
    count = np.diff(np.r_[at, height])[:, None] * (WIDTH // SIDE)
    return np.add.reduceat(pairs, at, axis=0) * 16 // count


def cosine_hashes(thumbs: np.ndarray) -> list[str]:
    """64 bits each, in hex: which low-frequency coefficients exceed the median of those beside the mean."""
    low = (COSINES @ thumbs.astype(np.float64) @ COSINES.T).reshape(len(thumbs), -1)
    bits = low > np.median(low[:, 1:], axis=1)[:, None]
    return [b.tobytes().hex() for b in np.packbits(bits, axis=1)]


def payload(text: str | None) -> bytes:
    """UTF-8, with bytes 0 up to a positive multiple of WIDTH."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def _encode(texts: pd.Series) -> pd.Series:
    return pd.Series([write_png(np.frombuffer(payload(t), np.uint8).reshape(-1, WIDTH)) for t in texts], dtype=object)


def _features(stored: pd.Series) -> pd.DataFrame:
    rows, thumbs = [], []
    for data in stored:
        samples = read_png(data)
        back = samples.tobytes()
        rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(data), hashlib.sha256(data).hexdigest()))
        thumbs.append(thumbnail(samples))
    out = pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"])
    out["feature"] = cosine_hashes(np.stack(thumbs)) if thumbs else pd.Series([], dtype=object)
    return out


def with_media(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """df with a binary column that holds each text as PNG; nulls are empty texts, which are 64 bytes 0."""
    ready(df.sparkSession)
    return df.withColumn(media, F.pandas_udf(_encode, "binary")(text_or_empty(text)))


def with_features(df: DataFrame, media: str = "media", features: str = "features") -> DataFrame:
    """df with a struct column of what the stored bytes say: sizes, digests, and the cosine hash. Broken bytes raise."""
    ready(df.sparkSession)
    return df.withColumn(features, F.pandas_udf(_features, FEATURE_TYPE)(F.col(media)))


def media_digest(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text); repeated rows and null ids pass through, other columns are ignored.

    No shuffle: PNG writing and reading are one pass in the Python worker, and equal texts get equal values.
    """
    slim = docs.select("doc_id", text_or_empty().alias("text"))
    return with_features(with_media(slim)).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "features.*")
