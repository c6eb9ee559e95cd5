"""Token ids as canonical length-limited Huffman codes.

Shards are Parquet tables of independent blocks. A block has the code of whole documents in ascending doc_id, each from a full
byte on, and a bit offset for every STEP-th id of a document: from these checkpoints the decoder, a table indexed by the
next bits, reads all stretches side by side. One code book, from the counts of the whole corpus, serves all blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duovox.llm.common import batch_udf, forget, ready, shared_folder, stash, text_or_empty
from duovox.llm.tokens import library_encoder

STEP = 128
LIMIT = 18
BLOCK_IDS = 1 << 18
FILE_IDS = 1 << 24
#: Ids drawn for each file to set the files' bounds.
SAMPLES = 100
#: Files at most: beyond FILES * FILE_IDS ids files grow instead, so bounds, file sizes and draws (FILES * SAMPLES at most, 16 MB) stay bounded.
FILES = 20_000
BLOCK_TYPE = "file int, block int, first_id long, doc_ids array<long>, counts array<int>, code binary, marks binary"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most limit bits, 0 for ids that don't occur, by package merging."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} ids don't fit in {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    level, packed = weights, []
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        by = np.argsort(both, kind="stable")
        packed.append(by >= n)
        level = both[by]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_package in reversed(packed):
        packages = int(is_package[:take].sum())
        lengths[: take - packages] += 1
        take = 2 * packages
    lengths[:take] += 1
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: ascending by (length, id)."""
    codes = np.zeros(len(lengths), np.uint32)
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    if len(used):
        room = np.int64(1) << (int(lengths.max()) - lengths[used].astype(np.int64))
        codes[used] = (np.cumsum(room) - room) // room
    return codes


def encode(ids: np.ndarray, counts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The code of consecutive documents (counts: their numbers of ids): bytes, byte offsets by document (with the end), and bit offsets of checkpoints."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    last = np.cumsum(counts)
    through = np.r_[0, ends][last]
    taken = (np.diff(np.r_[0, through]) + 7) // 8
    starts = np.cumsum(taken) - taken
    shift = starts * 8 - np.r_[0, through[:-1]]
    at = ends - size + np.repeat(shift, counts)
    total = int(taken.sum())
    words = total // 4 + 2
    value = codes[ids].astype(np.uint64) << (64 - size - (at & 31)).astype(np.uint64)
    word = at >> 5
    packed = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), words) + np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), words)
    place = np.arange(len(ids)) - np.repeat(last - counts, counts)
    return packed.astype(">u4").tobytes()[:total], np.r_[starts, total], at[place % STEP == 0]


class Decoder:
    """Reads blocks by a table over the next bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        used = used[np.argsort(lengths[used], kind="stable")]
        self.bits = max(1, int(lengths.max(initial=0)))
        room = np.int64(1) << (self.bits - lengths[used].astype(np.int64))
        self.ids = np.zeros(1 << self.bits, np.uint32)
        self.sizes = np.zeros(1 << self.bits, np.int64)
        spread = np.repeat(used, room)
        self.ids[: len(spread)] = spread
        self.sizes[: len(spread)] = lengths[spread]

    def stretch(self, code: bytes, offsets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The ids from each bit offset on, sizes[k] of them, in the order given."""
        data = np.frombuffer(code + bytes(8), np.uint8).astype(np.uint32)
        window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
        order = np.argsort(-sizes, kind="stable")
        bit, size = offsets[order].astype(np.int64), sizes[order]
        target = (np.cumsum(sizes) - sizes)[order]
        out = np.empty(int(sizes.sum()), np.uint32)
        shift = np.uint32(32 - self.bits)
        active = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")
        for k, n in enumerate(active):
            b = bit[:n]
            entry = window[b >> 3] << (b & 7).astype(np.uint32) >> shift
            out[target[:n] + k] = self.ids[entry]
            bit[:n] += self.sizes[entry]
        return out

    def block(self, code: bytes, counts: np.ndarray, marks: bytes) -> np.ndarray:
        """All ids of a block."""
        lanes = -(-counts // STEP)
        size = np.full(int(lanes.sum()), STEP)
        full = lanes > 0
        size[np.cumsum(lanes)[full] - 1] = (counts - (lanes - 1) * STEP)[full]
        return self.stretch(code, np.frombuffer(marks, "<u4"), size)


def token_table(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id and ids (packed 16- or 32-bit words, by the vocabulary's size) for each row, end id last."""
    model = ready(docs.sparkSession).sparkContext.broadcast(open(tokenizer, encoding="utf-8").read())

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = library_encoder(model.value)
        kind = word_type(encoder.library.get_vocab_size())
        for texts in parts:
            yield pd.Series([np.append(i, np.uint32(end_id)).astype(kind).tobytes() for i in encoder.encode_batch(texts)], dtype=object)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), batch_udf(run, "binary")(text_or_empty()).alias("ids"))


def word_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def id_counts(tokens: DataFrame, kind: str, vocabulary: int) -> np.ndarray:
    """How often each id occurs in all documents; each task sends one row per id, so at most `vocabulary` rows reach the driver."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(vocabulary, np.int64)
        for f in frames:
            total += np.bincount(np.frombuffer(b"".join(f["ids"]), kind), minlength=vocabulary)
        yield pd.DataFrame({"id": np.flatnonzero(total), "n": total[total > 0]})

    out = np.zeros(vocabulary, np.int64)
    for r in tokens.select("ids").mapInPandas(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def file_bounds(tokens: DataFrame, files: int, total: int, width: int) -> np.ndarray:
    """Ascending doc_ids that end all files but the last, so that files have about the same number of ids.

    Every (total / files / SAMPLES)th id or so is drawn, evenly and by hash, and its document noted: about SAMPLES rows of 8 bytes for
    each of at most FILES files reach the driver, however many documents there are.
    """
    share = F.octet_length("ids") / F.lit(width * total / (files * SAMPLES)) + F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    drawn = tokens.select(sort_id().alias("at"), F.floor(share).cast("int").alias("n")).where("n > 0")
    held = np.sort(drawn.select("at", F.explode(F.sequence(F.lit(1), "n"))).select("at").toArrow()["at"].to_numpy())
    return np.unique(held[np.linspace(0, len(held) - 1, files + 1).astype(np.int64)[1:-1]]) if len(held) else held


def sort_id() -> Column:
    """doc_id with null as the least number."""
    return F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))


def write_shards(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, limit: int = LIMIT, file_ids: int = FILE_IDS) -> None:
    """Write path/blocks (files in ascending doc_id; about file_ids ids each) and path/codebook (id, bits).

    The ids are encoded once and kept in a scratch table, since coding needs the counts of all of them. What is shuffled is the
    code, by ranges of doc_id that hold about the same number of ids (no document is larger than its own task can hold).
    Null ids come first; rows of one id lie side by side.
    """
    from tokenizers import Tokenizer

    spark = ready(docs.sparkSession)
    vocabulary = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    kind = word_type(vocabulary)
    width = np.dtype(kind).itemsize
    scratch = shared_folder(spark)
    tokens = stash(token_table(docs, tokenizer, end_id), scratch)
    counts = id_counts(tokens, kind, vocabulary)
    lengths = code_lengths(counts, limit)
    book = pd.DataFrame({"id": np.flatnonzero(lengths), "bits": lengths[lengths > 0].astype(int)})
    spark.createDataFrame(book, "id int, bits int").coalesce(1).write.parquet(f"{path}/codebook")
    total = int(counts.sum())
    files = min(FILES, max(1, -(-total // file_ids)))
    bounds = file_bounds(tokens, files, total, width) if files > 1 else np.empty(0, np.int64)
    shared = spark.sparkContext.broadcast((lengths, bounds))

    def code(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        lengths, bounds = shared.value
        codes = canonical_codes(lengths)
        for doc, ids in parts:
            sizes = np.array([len(i) for i in ids], np.int64) // width
            data, cuts, marks = encode(np.frombuffer(b"".join(ids), kind), sizes, lengths, codes)
            lanes = np.cumsum(-(-sizes // STEP))
            own = np.split((marks - np.repeat(cuts[:-1] * 8, -(-sizes // STEP))).astype("<u4"), lanes[:-1])
            yield pd.DataFrame({
                "file": np.searchsorted(bounds, doc.to_numpy(np.int64)).astype(np.int32), "n": sizes.astype(np.int32),
                "code": [data[a:b] for a, b in zip(cuts, cuts[1:])], "marks": [m.tobytes() for m in own],
            })

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, number, first = TaskContext.get().partitionId(), 0, 0
        docs_, sizes, parts, marks, at, held = [], [], [], [], 0, 0

        def close():
            nonlocal number, first, docs_, sizes, parts, marks, at, held
            row = (file, number, first, docs_, sizes, b"".join(parts), b"".join(marks))
            number, first = number + 1, first + held
            docs_, sizes, parts, marks, at, held = [], [], [], [], 0, 0
            return row

        for f in frames:
            rows = []
            for doc, no_id, n, data, own in zip(f["doc_id"], f["no_id"], f["n"], f["code"], f["marks"]):
                docs_.append(None if no_id else int(doc))
                sizes.append(n)
                parts.append(data)
                marks.append((np.frombuffer(own, "<u4") + np.uint32(at * 8)).tobytes())
                at += len(data)
                held += n
                if held >= BLOCK_IDS or at >= 1 << 28:
                    rows.append(close())
            yield pd.DataFrame(rows, columns=["file", "block", "first_id", "doc_ids", "counts", "code", "marks"])
        if docs_:
            yield pd.DataFrame([close()], columns=["file", "block", "first_id", "doc_ids", "counts", "code", "marks"])

    coded = batch_udf(code, "file int, n int, code binary, marks binary", 2)(sort_id(), F.col("ids"))
    rows = tokens.select(sort_id().alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), coded.alias("_out")).select("doc_id", "no_id", "_out.*")
    ordered = rows.repartitionById(files, F.col("file")).sortWithinPartitions(F.desc("no_id"), "doc_id")
    ordered.drop("file").mapInPandas(blocks, BLOCK_TYPE).write.option("compression", "none").parquet(f"{path}/blocks")
    forget(spark, scratch)


def read_shards(spark: SparkSession, path: str) -> tuple[DataFrame, Decoder, dict[int, int]]:
    """The blocks, a decoder for them, and the ids before each file. Code book and files are small tables of bounded size."""
    ready(spark)
    book = spark.read.schema("id int, bits int").parquet(f"{path}/codebook").toPandas()
    lengths = np.zeros(int(book["id"].max()) + 1 if len(book) else 1, np.uint8)
    lengths[book["id"]] = book["bits"]
    blocks = spark.read.schema(BLOCK_TYPE).parquet(f"{path}/blocks")
    each = blocks.select("file", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    sizes = sorted((r["file"], r["n"]) for r in each.groupBy("file").agg(F.sum("n").alias("n")).collect())
    before, total = {}, 0
    for file, n in sizes:
        before[file] = total
        total += n
    return blocks, Decoder(lengths), before


def by_document(blocks: DataFrame, columns: str, read: Callable[..., tuple]) -> DataFrame:
    """One row for each document: doc_id, and the items of the lists that read(file, first_id, counts, code, marks) gives for its block."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(parts: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for file, first, counts, code, marks in zip(*part):
                rows.append(read(file, first, np.asarray(counts, np.int64), code, marks))
            yield pd.DataFrame(rows, columns=names)

    typed = ", ".join(f"{c.split()[0]} array<{c.split()[1]}>" for c in columns.split(", "))
    out = batch_udf(run, typed, 5)("file", "first_id", "counts", "code", "marks")
    lists = blocks.select("doc_ids", out.alias("_out"))
    return lists.select(F.inline(F.arrays_zip(F.col("doc_ids").alias("doc_id"), *[F.col(f"_out.{n}").alias(n) for n in names])))


def shard_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids of each document in the shards."""
    blocks, decoder, before = read_shards(spark, path)
    shared = spark.sparkContext.broadcast((decoder, before))

    def read(file, first, counts, code, marks):
        decoder, before = shared.value
        ends = np.cumsum(counts)
        return before[file] + first + ends - counts, np.split(decoder.block(code, counts, marks).astype(np.int32), ends[:-1])

    return by_document(blocks, "start long, ids array<int>", read)


def shard_digest(docs: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Write shards and read them back: doc_id, start, n_tokens and ids_crc32 of each document, from the files.

    Null texts are empty and have the end id alone; long texts are coded whole. Null ids come before all others. Repeated rows are
    written each, in any order among themselves. Other columns are ignored; an empty table gives a file without blocks and no rows.
    """
    spark = docs.sparkSession
    path = path or shared_folder(spark)
    write_shards(docs, tokenizer, path, end_id)
    blocks, decoder, before = read_shards(spark, path)
    shared = spark.sparkContext.broadcast((decoder, before))

    def read(file, first, counts, code, marks):
        decoder, before = shared.value
        ends = np.cumsum(counts)
        data = memoryview(decoder.block(code, counts, marks).astype("<u4").tobytes())
        return before[file] + first + ends - counts, counts, [zlib.crc32(data[4 * (e - c) : 4 * e]) for c, e in zip(counts, ends)]

    return by_document(blocks, "start long, n_tokens long, ids_crc32 long", read)
