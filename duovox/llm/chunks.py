"""Texts cut where no byte-level or word tokenizer joins symbols, so that repeated chunks are encoded once.

The split pattern of the byte-level vocabulary never matches past the end of a run of visible characters,
so a run of white space with the visible run after it encodes alike in any context.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The mark of a key that is its chunk's whole text.
AS_IS = "\0"
#: The mark, white space other than the space and the line end, and controls that Python's isspace() counts though Unicode doesn't.
ODD_ASCII = "\0\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
ODD_WIDE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: All signs of ASCII.
PUNCTUATION = string.punctuation
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_chunk = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")


def spaced_chunks(text: str) -> list[str]:
    """Keys of chunks whose encodings, joined, are the encoding of text; '' gives none. literal() gives a key's text."""
    if not text:
        return []
    row = spaced_row(text)
    return [AS_IS + c for c in _chunk.findall(text)] if row is None else row.split(" ")


def spaced_row(text: str) -> str | None:
    """The keys of a text, which isn't empty, with a space between any two; None if it has more than single spaces and line ends."""
    if any(c in text for c in ODD_ASCII) or any(s in text for s in ("  ", "\n\n", " \n", "\n ")) or (not text.isascii() and any(c in text for c in ODD_WIDE)):
        return None
    row = text.replace("\n", " \n")
    return row[1:] if row[0] == " " else AS_IS + row


def key_table(texts: list[str], cut: Callable[[str], list[str]], rows: bool) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct keys of texts, the place among them of each key, text by text, and where each text's keys end.

    rows: cut is spaced_chunks, and Arrow splits the texts that have a spaced_row.
    """
    row = [spaced_row(t) if rows and t else None for t in texts]
    lists = [[] if r is not None else cut(t) for r, t in zip(row, texts)]
    split = pc.split_pattern(pa.array(row, pa.large_string()), " ")
    counts = np.array([*map(len, lists)], np.int64) + pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False)
    flat = pa.concat_arrays([pc.list_flatten(split), pa.array(chain.from_iterable(lists), pa.large_string())])
    coded = flat.dictionary_encode()
    place, ends = coded.indices.to_numpy(), np.cumsum(counts)
    quick = np.array([r is not None for r in row], bool)
    if quick.any() and not quick.all():  # those of the lists lie behind all others: back into the order of texts
        own = np.repeat(quick, counts)
        whole = np.empty_like(place)
        whole[own], whole[~own] = np.split(place, [int(own.sum())])
        place = whole
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), place, ends


def literal(key: str) -> str:
    """The text of a chunk's key: most chunks start with a space, which their keys leave out."""
    return key[1:] if key[:1] == AS_IS else key if key[:1] == "\n" else f" {key}"


def word_chunks(text: str) -> list[str]:
    """Runs of visible characters, for tokenizers that drop white space and case; a text with \\x1c-\\x1f stays whole.

    Plain ASCII is lower-cased here, which more chunks then share, unless it could turn into a special token.
    """
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [text]
    return (text.lower() if text.isascii() and "<|" not in text else text).split()


def plain_letters(word: str) -> bool:
    """Whether a word is letters only, of the Latin blocks below U+0250, none of which changes in number by case or normal form."""
    return word.isalpha() and (word.isascii() or (max(word) < "\u0250" and "\u0130" not in word and "\u0149" not in word))


class Cache:
    """Encodings by chunk, in two generations: once the young one is full it becomes the old one, so memory stays bounded."""

    def __init__(self, encode: Callable[[list[str]], list], limit: int = 400_000):
        self.encode, self.limit, self.young, self.old = encode, limit, {}, {}

    def lookup(self, texts: Iterable[list[str]]) -> list[list]:
        """The encodings of each chunk list; chunks that aren't known yet are encoded in one call."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        rows = [[*map(young.get, chunks)] for chunks in texts]
        gaps = [[] if all(row) else [k for k, e in enumerate(row) if e is None] for row in rows]
        wanted = {chunks[k] for chunks, gap in zip(texts, gaps) for k in gap}
        if wanted:
            young.update((w, old[w]) for w in wanted if w in old)
            missing = [*wanted.difference(old)] if old else [*wanted]
            young.update(zip(missing, self.encode(missing)))
            for chunks, row, gap in zip(texts, rows, gaps):
                for k in gap:
                    row[k] = young[chunks[k]]
        return rows

    def distinct(self, keys: list[str]) -> list:
        """The encodings of chunks none of which is there twice, with few steps for each."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        young, held = self.young, self.old.get
        out, missing = [*map(young.get, keys)], []
        for at, (key, e) in enumerate(zip(keys, out)):
            if e is None:
                e = held(key)
                if e is None:
                    missing.append(at)
                else:
                    out[at] = young[key] = e
        if missing:
            for at, e in zip(missing, self.encode([keys[at] for at in missing])):
                out[at] = young[keys[at]] = e
        return out
