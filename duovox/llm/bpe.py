"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. Each round looks up all neighbouring pairs in the sorted
pair keys of the merge list by binary search, and joins the pairs of lowest rank in each word.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from duovox.llm.chunks import AS_IS, SPACE, Cache, literal, spaced_chunks
from duovox.llm.common import batch_udf, ready, text_or_empty

#: The byte-level split pattern (fixed values), with white space as Unicode has it.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
NONE = np.iinfo(np.int64).max


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 as itself, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """Tables of a tokenizers file (JSON text) with a byte-level BPE model and neither normaliser nor prefix space."""

    def __init__(self, source: str, cache: int = 300_000):
        spec = json.loads(source)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.joined = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.first = np.empty(256, np.int64)
        for letter, b in letters.items():
            self.first[b] = vocab[letter]
        spelled = {i: bytes(letters[c] for c in s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        parts = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        self.length = np.array([len(p) for p in parts], np.int64)
        self.offset = np.cumsum(self.length) - self.length
        self.blob = np.frombuffer(b"".join(parts), np.uint8)
        self.split = regex.compile(PATTERN)
        marks = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.marks = regex.compile(f"({marks})") if marks else None
        self.whole = any(any(c.isspace() for c in s) for s in self.special)
        self.cache = Cache(self._encode_chunks, cache)

    def merge_words(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word (not empty), by rounds over all of them at once."""
        sizes = np.array([len(w) for w in words], np.int64)
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        done_owner, done_symbols = [], []
        while len(symbols):
            same = owner[1:] == owner[:-1]
            pair = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.full(len(symbols), NONE)
            rank[:-1] = np.where(same & (self.keys[at] == pair), self.order[at], NONE)
            starts = np.flatnonzero(np.r_[True, ~same])
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(symbols)]))
            ended = best == NONE
            done_owner.append(owner[ended])
            done_symbols.append(symbols[ended])
            hit = np.flatnonzero((rank == best) & ~ended)
            if not len(hit):
                break
            # of overlapping equal pairs (a a a) every second one counts, from the left
            new_run = np.r_[True, np.diff(hit) != 1]
            run_start = np.flatnonzero(new_run)
            place = np.arange(len(hit)) - np.repeat(run_start, np.diff(np.r_[run_start, len(hit)]))
            hit = hit[place % 2 == 0]
            symbols[hit] = self.joined[rank[hit]]
            keep = ~ended
            keep[hit + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        owner, symbols = np.concatenate(done_owner), np.concatenate(done_symbols)
        order = np.argsort(owner, kind="stable")
        ends = np.cumsum(np.bincount(owner, minlength=len(words)))
        return np.split(symbols[order], ends[:-1])

    def _pieces(self, chunk: str) -> list[str | int]:
        out: list[str | int] = []
        for k, part in enumerate(self.marks.split(chunk) if self.marks else [chunk]):
            if k % 2:
                out.append(self.special[part])
            else:
                out.extend(self.split.findall(part))
        return out

    def _encode_chunks(self, chunks: list[str]) -> list[tuple[bytes, str]]:
        """Each chunk's ids as little-endian 32-bit words, and as decimals that each end with a comma."""
        cut = [self._pieces(literal(c)) for c in chunks]
        words = list({p for pieces in cut for p in pieces if isinstance(p, str)})
        ids = dict(zip(words, self.merge_words([w.encode("utf-8", "replace") for w in words]))) if words else {}
        out = []
        for pieces in cut:
            row = [i for p in pieces for i in ([p] if isinstance(p, int) else ids[p].tolist())]
            out.append((np.array(row, "<u4").tobytes(), "".join([f"{i}," for i in row])))
        return out

    def encode_batch(self, texts: Iterable[str]) -> Iterator[tuple[np.ndarray, str]]:
        """For each text: its ids, and the ids in decimal joined by commas."""
        for row in self.cache.lookup([([AS_IS + t] if t else []) if self.whole else spaced_chunks(t) for t in texts]):
            yield np.frombuffer(b"".join([g[0] for g in row]), "<u4"), "".join([g[1] for g in row])[:-1]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included; broken UTF-8 becomes U+FFFD, unknown ids nothing."""
        known = ids[ids < len(self.length)].astype(np.int64)
        sizes = self.length[known]
        total = int(sizes.sum())
        start = self.offset[known] - (np.cumsum(sizes) - sizes)
        return self.blob[np.arange(total) + np.repeat(start, sizes)].tobytes().decode("utf-8", "replace")


@functools.lru_cache(maxsize=1)
def byte_bpe(source: str) -> ByteBPE:
    """One for each Python worker: the tasks that it runs one after another share the cache of chunks."""
    return ByteBPE(source)


def bpe_columns(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (array of int) and decoded (string) for each row; null texts are empty and have no ids."""
    model = ready(df.sparkSession).sparkContext.broadcast(open(tokenizer, encoding="utf-8").read())

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = byte_bpe(model.value)
        for texts in parts:
            ids = [i for i, _ in bpe.encode_batch(texts)]
            yield pd.DataFrame({"ids": [i.astype(np.int32) for i in ids], "decoded": [bpe.decode(i) for i in ids]})

    return df.select(key, batch_udf(run, "ids array<int>, decoded string")(text_or_empty(text)).alias("_out")).select(key, "_out.*")


def bpe_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row's whole text, in one pass without a shuffle.

    The vocabulary file (of fixed size) is read on the driver and broadcast. Null texts count as empty: no ids,
    and the digests are those of the empty string. Long texts are encoded whole, in a batch of their own beyond the batch's bytes.
    Repeated rows and null ids pass through; other columns are ignored; an empty table gives no rows.
    """
    model = ready(docs.sparkSession).sparkContext.broadcast(open(tokenizer, encoding="utf-8").read())

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = byte_bpe(model.value)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for texts in parts:
            rows = [(len(ids), sha(said), sha(bpe.decode(ids))) for ids, said in bpe.encode_batch(texts)]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    digest = batch_udf(run, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return docs.select("doc_id", digest(text_or_empty()).alias("_out")).select("doc_id", "_out.*")
