"""Fill-in-middle: texts cut into prefix, middle and suffix, and put together again around marks.

Cuts count code points, texts are UTF-8. A rolling hash of the last WINDOW bytes cuts a text into chunks where its low bits are zero, so texts
that share a passage share its chunks. A chunk's summary (code points, and what its ends and inside say about marks) is kept in a cache by
content hash and used again only where the whole content is equal. Sums over the chunks' counts find the chunk that holds a cut; only that
one is looked into.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duovox.llm.common import batch_udf, ready, text_or_empty

#: The marks, and the shares (in hundredths) of plain texts and of suffix-first ones.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
#: Bytes that the rolling hash sees, a power of two; and a chunk's least, usual and largest size.
WINDOW, LEAST, USUAL, MOST = 32, 256, 1024, 8192
#: Bytes of chunks that a worker's cache holds at most in each of its two generations.
CACHE_BYTES = 16 << 20
GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)
LEADS = np.array([b & 0xC0 != 0x80 for b in range(256)])


def chunk_ends(data: bytes) -> list[int]:
    """Where chunks end, by content: the places where the rolling hash is zero in its low bits, LEAST to MOST bytes apart."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = GEAR[np.frombuffer(data, np.uint8)]
    step = 1
    while step < WINDOW:  # each step doubles the bytes that a place's hash covers
        h[step:] += h[:-step].copy() << np.uint32(step)
        step *= 2
    ends, last = [], 0
    for at in (np.flatnonzero((h >> np.uint32(22)) % np.uint32(USUAL) == 0) + 1).tolist():
        while at - last > MOST:
            last += MOST
            ends.append(last)
        if at - last >= LEAST:
            ends.append(at)
            last = at
    while n - last > MOST:
        last += MOST
        ends.append(last)
    return ends if last == n else [*ends, n]


def marked(data: bytes) -> bool:
    return b"<" in data and (PREFIX in data or SUFFIX in data or MIDDLE in data)


class Summaries:
    """Summaries of chunks (code points, whether a mark lies inside) by content hash; two generations bound the memory."""

    def __init__(self, limit: int = CACHE_BYTES):
        self.limit, self.size, self.young, self.old, self.hits = limit, 0, {}, {}, 0

    def of(self, chunk: bytes) -> tuple[int, bool]:
        key = xxhash.xxh3_64_intdigest(chunk)
        known = self.young.get(key) or self.old.get(key)
        if known and known[0] == chunk:  # another content of the same hash is summed up anew
            self.hits += 1
            return known[1]
        count = len(chunk) if chunk.isascii() else int(LEADS[np.frombuffer(chunk, np.uint8)].sum())
        if self.size > self.limit:
            self.old, self.young, self.size = self.young, {}, 0
        self.young[key] = (chunk, (count, marked(chunk)))
        self.size += len(chunk) + 128
        return count, self.young[key][1][1]


class Measured:
    """A text's chunks with their summaries: its code points, whether a mark occurs, and the byte where a code point starts."""

    def __init__(self, data: bytes, cache: Summaries):
        self.data, self.ends, counts, self.marked = data, chunk_ends(data), [], False
        start = 0
        for end in self.ends:
            count, inside = cache.of(data[start:end])
            # a mark may lie across the end before this chunk
            self.marked = self.marked or inside or marked(data[max(0, start - 2) : start + 2])
            counts.append(count)
            start = end
        self.upto = np.cumsum([0, *counts])
        self.length = int(self.upto[-1])

    def offset(self, place: int) -> int:
        """The byte where code point number `place` starts; the text's length in bytes for its length in code points."""
        if place >= self.length:
            return len(self.data)
        k = int(np.searchsorted(self.upto, place, "right")) - 1
        start, rest = self.ends[k - 1] if k else 0, place - int(self.upto[k])
        piece = self.data[start : self.ends[k]]
        return start + (rest if piece.isascii() else int(np.flatnonzero(LEADS[np.frombuffer(piece, np.uint8)])[rest]))


def draws(salt: str = "1", column: str = "doc_id") -> list[Column]:
    """The first four 32-bit numbers of the SHA-256 of salt, a colon and the id in decimal (nothing for a null id)."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col(column).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def arranged(data: bytes, h: tuple[int, int, int, int], cache: Summaries) -> tuple[int, str, int | None, int | None, bytes]:
    """Code points, form, code points of prefix and middle, and the text in its form."""
    text = Measured(data, cache)
    n = text.length
    if not n or text.marked or h[2] % 100 >= PLAIN_FROM:
        return n, "plain", None, None, data
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = text.offset(low), text.offset(high)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if h[3] % 100 < SPM_BELOW:
        return n, "spm", low, high - low, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", low, high - low, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def rebuilt(data: bytes, form: str) -> bytes:
    """The text of an arrangement. Texts hold no marks, and a mark cannot start inside another, so the first of each is the one put in."""
    if form == "plain":
        return data
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, rest = data[len(first) :].split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    return one + middle + two if form == "psm" else two + middle + one


def with_infill(docs: DataFrame, salt: str = "1") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output (the arranged text) of each row of docs (doc_id, text).

    A null text is empty and stays plain, as do texts with a mark. A null id draws as an empty one; repeated rows give repeated, equal rows;
    an empty table gives none; other columns are ignored. Texts are worked on one by one as bytes, at any length, with some
    fixed multiple of the text in memory. One pass without a shuffle; the cache changes the time, never a result.
    """
    return _arranged(docs, salt, lambda data, form: data.decode("utf-8"), "output string")


def infill_digest(docs: DataFrame, salt: str = "1") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the SHA-256 of the arranged text and of the text rebuilt from it alone."""

    def digests(data: bytes, form: str) -> tuple[str, str]:
        return hashlib.sha256(data).hexdigest(), hashlib.sha256(rebuilt(data, form)).hexdigest()

    return _arranged(docs, salt, digests, "output_sha256 string, restored_sha256 string")


def _arranged(docs: DataFrame, salt: str, result, returns: str) -> DataFrame:
    names = [c.split()[0] for c in returns.split(", ")]

    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        cache = Summaries()
        for texts, *numbers in parts:
            rows = []
            for data, *h in zip(texts, *(x.tolist() for x in numbers)):
                *made, out = arranged(data, h, cache)
                last = result(out, made[1])
                rows.append((*made, *(last if isinstance(last, tuple) else (last,))))
            frame = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", *names])
            yield frame.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    ready(docs.sparkSession)
    infill = batch_udf(run, f"n long, form string, prefix_chars long, middle_chars long, {returns}", 5)
    slim = docs.select("doc_id", infill(text_or_empty().cast("binary"), *draws(salt)).alias("_out"))
    return slim.select("doc_id", "_out.*")


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT doc_id, text, n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(text, 1, a) AS pre, substring(text, a + 1, b - a) AS mid, substring(text, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
