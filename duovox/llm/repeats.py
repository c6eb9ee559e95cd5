"""Substring dedup: documents are parsed, by relative Lempel-Ziv, into factors that repeat passages of an index of the whole corpus.

The index is made of reference blocks that content cuts out. Every window of WORDS words is named by its anchor, the least hash among the
grams of GRAM words in it (the last of equals), so equal windows have their anchors at equal places. Neighbouring windows of one
anchor are a block: up to 28 windows, 62 words. Blocks overlap by WORDS - 1 words, so every window lies whole in exactly one block of its text,
and equal windows can only meet in blocks of equal anchors.

A document is parsed from left to right. Where the index holds a block in another place too, the parse goes on to the next block, and the
factor grows as long as the blocks that follow lie in a row at the home of the first (their first place in the corpus): the greedy choice.
At the boundaries of factors a block as a whole is new though its anchor isn't; there each of its windows is looked up among the windows of
all indexed blocks of that anchor. A factor has WORDS words at least, and its words are a duplicate span.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duovox.llm.common import forget, ready, text_or_empty
from duovox.llm.near import STEPS, Scratch, WordHashes, mix

WORDS = 35
GRAM = 8
#: Windows that are searched for anchors at a time: a place within them fits the low bits of a hash.
PIECE, LOW = 1 << 22, np.uint64((1 << 24) - 1)


def hashed(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def rolled(x: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A 64-bit hash of every `size` neighbours, in their order: joined from runs of 1, 2, 4... elements."""
    part, step, out, done = mix(x ^ STEPS[seed]), 1, None, 0
    n = len(x) - size + 1
    while True:
        if size & step:
            out = part[:n] if out is None else mix(out[:n] * STEPS[0] + part[done : done + n])
            done += step
        if done == size:
            return out
        part = mix(part[:-step] * STEPS[1] + part[step:])
        step *= 2


def anchors(grams: np.ndarray, span: int) -> np.ndarray:
    """The place of the least of every `span` neighbours by its high bits, the last of equals."""
    n = len(grams) - span + 1
    out = np.empty(n, np.int64)
    for low in range(0, n, PIECE):
        part = grams[low : min(n, low + PIECE) + span - 1]
        key = part & ~LOW | LOW - np.arange(len(part), dtype=np.uint64)
        size = 1
        while 2 * size <= span:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        if size < span:
            key = np.minimum(key[: size - span], key[span - size :])
        out[low : low + len(key)] = low + (LOW - (key & LOW)).astype(np.int64)
    return out


def blocks(x: np.ndarray, words: int = WORDS, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchor, 128 bits of content, first window and number of windows of each block of a text of at least `words` hashed words.

    The first and the last window of a block cover it, so their hashes and their distance name its content.
    """
    grams = rolled(x, gram, 2)
    at = anchors(grams, words - gram + 1)
    start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.append(start, len(at)))
    sides = []
    for seed in (3, 4):
        w = rolled(x, words, seed)
        sides.append(mix(w[start] * STEPS[0] + w[start + count - 1] * STEPS[1] + count.astype(np.uint64)).view(np.int64))
    return grams[at[start]].view(np.int64), *sides, start, count


def parsed_blocks(texts: DataFrame, words: int, gram: int) -> DataFrame:
    """row, anchor, a, b, start, count of every block of texts (row, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for f in frames:
            made = [(row, blocks(hashed(split, hashes), words, gram)) for row, data in zip(f["row"], f["text"]) if len(split := data.split()) >= words]
            if made:
                columns = dict(zip(("anchor", "a", "b", "start", "count"), (np.concatenate(c) for c in zip(*(m for _, m in made)))))
                yield pd.DataFrame({"row": np.repeat([r for r, _ in made], [len(m[0]) for _, m in made])} | columns)

    return texts.mapInPandas(run, "row long, anchor long, a long, b long, start int, count int")


def windows(homes: DataFrame, words: int) -> DataFrame:
    """w1, w2 (the content of a window), row, start and n of each window of the blocks (start, count, n) of texts; n as for the block."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for f in frames:
            out = []
            for row, data, held in zip(f["row"], f["text"], f["blocks"]):
                x = hashed(data.split(), hashes)
                first, count, n = (np.array([b[c] for b in held], np.int64) for c in ("start", "count", "n"))
                start = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                out.append(pd.DataFrame({"w1": rolled(x, words, 3)[start].view(np.int64), "w2": rolled(x, words, 4)[start].view(np.int64), "row": row, "start": start, "n": np.repeat(n, count)}))
            if out:
                yield pd.concat(out)

    return homes.mapInPandas(run, "w1 long, w2 long, row long, start int, n long")


def factors(found: list[tuple[int, int, int, int]], words: int) -> list[tuple[int, int, int, int]]:
    """(start, length, home, place there), in words, of the factors of one text, from its repeated (start, count, home, place there), by start.

    Greedy: a factor takes in what follows without a gap, here and at its home.
    """
    out: list[list[int]] = []
    for start, count, home, place in found:
        last = out[-1] if out else None
        if last and start == last[0] + last[1] and home == last[2] and place - start == last[3] - last[0]:
            last[1] += count
        else:
            out.append([start, count, home, place])
    return [(start, count + words - 1, home, place) for start, count, home, place in out]


def without_repeats(docs: DataFrame, words: int = WORDS, gram: int = GRAM) -> DataFrame:
    """doc_id, row, n_words, n_removed, text (the words that stay, joined by one space) and factors of each row of docs (doc_id, text).

    Words are runs of characters other than ASCII white space. A word goes if a window of `words` words that covers it starts somewhere else
    too, in any row, its own included; windows are judged on the input, so all copies of a passage go. factors: start and length in words of each
    duplicate span, with the row and the word where its content is found first (overlapping spans count once in n_removed). row numbers the
    rows of this run. Null texts are empty; null ids are ids like others; repeated rows are copies of each other and so lose their windows;
    texts of fewer words lose nothing; an empty table gives no rows; other columns are ignored. A long text is one array in its task.

    Plan: texts get row numbers in a table in the shared folder -> their blocks (one row for about 14 words), a table -> groups by anchor, with
    partial sums: only anchors of two places or more go on -> where all blocks of an anchor are equal they are duplicates -> else distinct blocks
    (groups by content), one home each, whose windows are counted -> back to the texts by row. A passage of any number of copies is
    summed up in the tasks before it moves, and joins by anchor or content have unique keys on one side, so adaptive execution
    can split a hot one. 128-bit hashes stand for contents.
    """
    spark = ready(docs.sparkSession)
    scratch = Scratch(spark)
    texts, _ = scratch.keep(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_or_empty().cast("binary").alias("text")))
    every, every_at = scratch.keep(parsed_blocks(texts.select("row", "text"), words, gram))
    # anchors of two places or more; open: their blocks differ
    place = F.struct("row", "start")
    groups = every.groupBy("anchor").agg(F.count("*").alias("n"), F.min("a").alias("low"), F.max("a").alias("high"), F.min(place).alias("home"))
    shared, shared_at = scratch.keep(groups.where("n > 1").select("anchor", (F.col("low") != F.col("high")).alias("open"), "home"))
    held, _ = scratch.keep(every.join(shared, "anchor").select("row", "start", "count", "a", "b", "open", "home"))
    forget(spark, every_at, shared_at)
    closed = held.where("NOT open").select("row", "start", "count", "home")
    # distinct blocks of the open anchors
    distinct, _ = scratch.keep(held.where("open").groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct("row", "start", "count")).alias("home")))
    again = held.where("open").join(distinct.where("n > 1").select("a", "b", F.struct("home.row", "home.start").alias("first")), ["a", "b"])
    whole = again.select("row", "start", "count", F.col("first").alias("home"))
    # windows at the boundaries: of blocks that occur once, against those of all distinct blocks
    homes = distinct.select("home.row", F.struct("home.start", "home.count", "n").alias("block")).groupBy("row").agg(F.collect_list("block").alias("blocks"))
    single, _ = scratch.keep(windows(texts.select("row", "text").join(homes, "row"), words))
    found, _ = scratch.keep(single.groupBy("w1", "w2").agg(F.sum("n").alias("n"), F.min(place).alias("home")).where("n > 1").select("w1", "w2", "home"))
    parts = single.where("n = 1").join(found, ["w1", "w2"]).select("row", "start", F.lit(1).alias("count"), "home")

    spans = closed.unionByName(whole).unionByName(parts).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "count", F.col("home.row").alias("home"), F.col("home.start").alias("place")))).alias("found"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for data, found in zip(f["text"], f["found"]):
                split = data.split()
                made = factors([(s["start"], s["count"], s["home"], s["place"]) for s in found] if found is not None else [], words)
                stays = np.ones(len(split), bool)
                for start, length, _, _ in made:
                    stays[start : start + length] = False
                rows.append((len(split), len(split) - int(stays.sum()), b" ".join(compress(split, stays)).decode("utf-8", "replace"), [dict(zip(("start", "length", "row", "place"), m)) for m in made]))
            ids = f[["doc_id", "row"]].reset_index(drop=True)
            yield pd.concat([ids, pd.DataFrame(rows, columns=["n_words", "n_removed", "text", "factors"])], axis=1)

    kind = docs.schema["doc_id"].dataType.simpleString()
    # ids travel as text: pandas would turn whole numbers beside a null into doubles
    joined = texts.withColumn("doc_id", F.col("doc_id").cast("string")).join(spans, "row", "left")
    out = joined.mapInPandas(run, "doc_id string, row long, n_words long, n_removed long, text string, factors array<struct<start: int, length: int, row: long, place: int>>")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def repeats_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the words that stay, for each row of docs."""
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT doc_id, i, string_agg(word, ' ') OVER ahead AS passage, count(*) OVER ahead AS n FROM u WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
r AS (SELECT passage FROM k WHERE n = 35 GROUP BY passage HAVING count(*) > 1),
s AS (SELECT doc_id, i FROM k JOIN r USING (passage) WHERE n = 35),
m AS (SELECT u.doc_id, u.i, u.word, coalesce(max(s.i) OVER (PARTITION BY u.doc_id ORDER BY u.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) > 0 AS gone FROM u LEFT JOIN s ON s.doc_id = u.doc_id AND s.i = u.i)
SELECT d.doc_id, len(any_value(d.w))::BIGINT AS n_words, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM d LEFT JOIN m ON m.doc_id = d.doc_id GROUP BY d.doc_id
"""
