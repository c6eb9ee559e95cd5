"""The tokenizers library behind a cache of chunks: every chunk is encoded by the library, repeated ones once."""

from __future__ import annotations

import codecs
import functools
import json
import os
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np

from duovox.llm.bpe import byte_letters
from duovox.llm.chunks import AS_IS, PUNCTUATION, Cache, key_table, literal, plain_letters, spaced_chunks, word_chunks


class LibraryEncoder:
    """Encodes whole texts as tokenizers.Tokenizer.encode(text, add_special_tokens=False) does, without truncation or padding.

    Texts are cut where the file's split pattern always cuts, by spaced_chunks (byte-level patterns) or word_chunks
    (patterns that drop white space), chosen by the file's pre-tokenizer. The library encodes each new chunk; words
    of Latin letters, which every such pattern keeps whole, go straight to the library's merge model.
    """

    def __init__(self, source: str, cache: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(source)
        self.library = Tokenizer.from_str(source)
        self.library.no_truncation()
        self.library.no_padding()
        kinds = json.dumps(spec["pre_tokenizer"])
        self.drops = '"Removed"' in kinds and spec["pre_tokenizer"]["type"] == "Sequence"
        self.cut: Callable[[str], list[str]] = word_chunks if self.drops else spaced_chunks
        letters = {b: c for c, b in byte_letters().items()}
        self.model, self.letters, self.space = self.library.model, "".join(letters[b] for b in range(256)), letters[32]
        self.newline = array("I", self.library.encode("\n", add_special_tokens=False).ids).tobytes()
        self.tails: dict[str, bytes] = {}
        # no tail is cut off where an added token could lie across its border
        self.closing = "" if any(plain_letters(t["content"].rstrip(PUNCTUATION)) for t in spec["added_tokens"]) else PUNCTUATION
        if any(any(c.isspace() for c in t["content"]) for t in spec["added_tokens"]):
            self.cut = lambda text: [text if self.drops else AS_IS + text] if text else []
        self.cache = Cache(self._encode_chunks, cache)

    def _spelled(self, word: str) -> str | None:
        """How the merge model spells a word of plain letters; None for anything else."""
        if word.isalpha():
            if word.isascii():
                return word.lower() if self.drops else word
            if plain_letters(word):
                return codecs.charmap_decode((word.lower() if self.drops else word).encode(), "strict", self.letters)[0]
        return None

    def _tail(self, tail: str) -> bytes:
        """The ids of signs after a word of plain letters."""
        ids = self.tails.get(tail)
        if ids is None:
            ids = array("I", self.library.encode(tail, add_special_tokens=False).ids).tobytes()
            if len(tail) <= 16 and len(self.tails) < 10_000:
                self.tails[tail] = ids
        return ids

    def _encode_chunks(self, keys: list[str]) -> list[bytes]:
        """ASCII signs after a word of plain letters are encoded apart, so that the word is looked up like any other."""
        known, old, out, rest = self.cache.young, self.cache.old, [None] * len(keys), []
        tokenize, space = self.model.tokenize, "" if self.drops else self.space
        for at, key in enumerate(keys):
            core, lead, before = key.rstrip(self.closing), b"", space
            tail = key[len(core) :]
            if core[:1] == "\n":
                core, lead, before = core[1:], self.newline, ""
            elif core[:1] == AS_IS and not self.drops:
                core, before = core[1:], ""
            plain = before == space  # what the cache holds for the core alone
            ids = known.get(core) or old.get(core) if tail and plain and plain_letters(core) else None
            if ids is None:
                spelled = self._spelled(core)
                if spelled is None:
                    rest.append(at)
                    continue
                ids = array("I", [t.id for t in tokenize(before + spelled)]).tobytes()
                if tail and plain:
                    known[core] = ids
            out[at] = lead + ids + self._tail(tail) if tail else lead + ids
        texts = [keys[at] if self.drops else literal(keys[at]) for at in rest]
        for at, e in zip(rest, self.library.encode_batch_fast(texts, add_special_tokens=False)):
            out[at] = array("I", e.ids).tobytes()
        return out

    def encode_batch(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text, little-endian 32-bit. Each distinct chunk of the texts is looked up once."""
        keys, place, ends = key_table([*texts], self.cut, self.cut is spaced_chunks)
        found = np.array(self.cache.distinct(keys), object)
        for start, end in zip(chain([0], ends), ends):
            yield np.frombuffer(b"".join(found[place[start:end]].tolist()), "<u4")


@functools.lru_cache(maxsize=1)
def library_encoder(source: str) -> LibraryEncoder:
    """One for each Python worker: the tasks that it runs one after another share the cache of chunks."""
    return LibraryEncoder(source)
