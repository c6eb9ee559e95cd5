"""Best-two-fit packing of token sequences.

Lengths are whole numbers up to the sequence size, so the packing is planned on the counts of each length: that table
has at most `size` rows, however large the corpus. A bin is filled greedily, largest first; then its smallest
piece gives way to two unpacked ones that fill the widened gap more tightly, as long as such a pair exists. The same
bin is repeated as often as the counts allow. Pieces then find their places by their rank within their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duovox.llm.common import batch_udf, ready, shared_folder, stash, text_or_empty
from duovox.llm.tokens import library_encoder

RANKS = 48  # bits of a rank within a length


def best_pair(free: np.ndarray, space: int) -> tuple[int, int] | None:
    """The two free lengths of largest sum within space; free[n] is how many pieces of length n are left."""
    space = min(space, 2 * (len(free) - 1))
    floor = np.maximum.accumulate(np.where(free > 0, np.arange(len(free)), 0))
    a = np.flatnonzero(free[: space // 2 + 1] > 0)
    if not len(a):
        return None
    b = floor[np.minimum(space - a, len(free) - 1)]
    alone = (b == a) & (free[a] < 2)
    b = np.where(alone, floor[np.maximum(a - 1, 0)], b)
    total = np.where(b > 0, a + b, 0)
    k = int(total.argmax())
    return (int(b[k]), int(a[k])) if total[k] else None


def plan(counts: dict[int, int], size: int) -> np.ndarray:
    """Slots (length, first rank, sequence, offset), by length and rank: ranks first, first + 1, ... of a length go to
    sequences sequence, sequence + 1, ... at that offset, up to the length's next slot.

    Every length from 1 to size may occur; all pieces get a slot.
    """
    left = np.zeros(size + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    rank, sequence, slots = np.zeros(size + 1, np.int64), 0, []
    while left.any():
        free = left.copy()
        gap, bin_ = size, []
        while gap and len(fits := np.flatnonzero(free[: gap + 1])):
            n = int(fits[-1])
            times = min(gap // n, int(free[n])) if bin_ else 1
            bin_ += [n] * times
            free[n] -= times
            gap -= n * times
        while gap and len(bin_) > 1:
            pair = best_pair(free, gap + bin_[-1])
            if not pair or sum(pair) <= bin_[-1]:
                break
            out = bin_.pop()
            free[out] += 1
            gap += out - sum(pair)
            bin_ = sorted([*bin_, *pair], reverse=True)
            for n in pair:
                free[n] -= 1
        used = left - free
        repeats = int((left[used > 0] // used[used > 0]).min())
        offset = 0
        for n in bin_:
            slots.append((n, rank[n], sequence, offset))
            rank[n] += repeats
            offset += n
        sequence += repeats
        left -= used * repeats
    return np.array(sorted(slots), np.int64).reshape(-1, 4)


def pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int) -> DataFrame:
    """One row per piece, with its task and its rank among the task's pieces of that length. Null ids travel as 0 beside a mark."""
    model = ready(docs.sparkSession).sparkContext.broadcast(open(tokenizer, encoding="utf-8").read())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, seen, task = library_encoder(model.value), np.zeros(size + 1, np.int64), TaskContext.get().partitionId()
        for f in frames:
            rows = []
            for doc, no_id, ids in zip(f["doc_id"], f["no_id"], encoder.encode_batch(f["text"])):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), size)):
                    part = ids[at : at + size]
                    rows.append((doc, no_id, k, at, len(part), zlib.crc32(part.tobytes()), task, seen[len(part)]))
                    seen[len(part)] += 1
            yield pd.DataFrame(rows, columns=["doc_id", "no_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    slim = docs.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), text_or_empty().alias("text"))
    cut = slim.mapInPandas(run, "doc_id long, no_id boolean, piece int, start long, length long, ids_crc32 long, task int, rank long")
    return cut.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset for each piece of each row's text.

    Ids come from the tokenizers library, with end_id after them. Only texts of over size ids are cut, at multiples of
    size. A null text is empty and has the end id alone; long texts are encoded whole. Repeated rows are packed each; rows with a null id too. Other columns
    are ignored; an empty table gives no rows.

    The pieces, without their ids, are written to the shared folder once, which fixes their tasks and ranks. Counts by
    (length, task) give each task its first rank; only counts by length, size rows at most, reach the driver.
    """
    spark = docs.sparkSession
    cut = stash(pieces(docs, tokenizer, size, end_id), shared_folder(spark))
    by_task = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    order = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("length", "task", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(plan(counts, size))

    def place(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        length, first, sequence, offset = slots.value.T
        keys = length << RANKS | first
        for n, rank in parts:
            rank = rank.to_numpy()
            at = np.searchsorted(keys, n.to_numpy() << RANKS | rank, side="right") - 1
            yield pd.DataFrame({"sequence_id": sequence[at] + rank - first[at], "offset": offset[at]})

    where = batch_udf(place, "sequence_id long, offset long", 2)(F.col("length"), F.col("rank") + F.col("before"))
    return cut.join(before, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", where.alias("_at")).select("doc_id", "piece", "start", "length", "ids_crc32", "_at.*")
