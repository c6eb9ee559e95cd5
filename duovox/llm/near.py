"""MinHash near-duplicates: fast similarity sketches, banding, exact verification, components.

A sketch has COORDINATES bins. In each round every shingle of a document is thrown into one bin, which keeps the least value;
later rounds have larger values, and round COORDINATES + k throws all shingles into bin k, so every bin
fills. Documents stop after the round that fills their last bin. Agreement of two sketches concentrates around
the Jaccard similarity as for independent minima.

Bands of ROWS coordinates make candidates: with 40 bands of 4, a pair at similarity 0.75 is missed with
probability (1 - 0.75^4)^40 = 3e-7. All members of a bucket are compared with one pivot; what that leaves unconnected
meets in blocks of sketches, where a pair needs AGREE equal coordinates (at similarity 0.75 fewer have a
probability of 2e-7). Links are confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duovox.llm.common import batch_udf, forget, ready, shared_folder, stash, text_or_empty

WORDS = 5
BANDS, ROWS = 40, 4
COORDINATES = BANDS * ROWS
PERCENT = 75
#: Equal coordinates, of COORDINATES, below which a pair isn't worth an exact comparison: 0.75 of them less 5 standard deviations.
AGREE = 92
#: Members of a block, and bytes of their full sets, on average at most; every two blocks of a bucket are compared as one group.
BLOCK, BLOCK_BYTES = 1024, 16 << 20
#: A bucket's pivot is its least member in one of so many orders, chosen by band.
ORDERS = 4
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
STEPS = [np.uint64(v) for v in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes by word; forgets all once it is large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str, hashes: WordHashes, size: int = WORDS) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles. Bytes do: splitting and lower-casing UTF-8 touch ASCII alone."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    x = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(x) - size + 1)
    total = np.full(n, len(words) if len(words) < size else 0, np.uint64)
    for k in range(min(size, len(x))):
        total += x[k : k + n] * STEPS[k % len(STEPS)] * np.uint64(2 * (k // len(STEPS)) + 1)
    return np.unique(mix(total))


def sketches(sets: list[np.ndarray], t: int = COORDINATES) -> np.ndarray:
    """One row of t coordinates for each set, none of them empty."""
    out = np.full(len(sets) * t, np.iinfo(np.uint64).max)
    sizes = np.array([len(s) for s in sets], np.int64)
    items, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    for i in range(2 * t):
        h = mix(items + np.uint64((i + 1) * int(STEPS[0]) % (1 << 64)))
        spot = h % np.uint64(t) if i < t else np.full(len(h), i - t, np.uint64)
        value = np.uint64(i) << np.uint64(54) | mix(h) >> np.uint64(10)
        np.minimum.at(out, owner * t + spot.astype(np.int64), value)
        open_ = (out.reshape(-1, t) == np.iinfo(np.uint64).max).any(axis=1)
        if not open_.any():
            break
        keep = open_[owner]
        items, owner = items[keep], owner[keep]
    return out.reshape(-1, t)


def band_keys(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each sketch; equal keys of different bands are as unlikely as any collision."""
    n, t = sketch.shape
    parts = sketch.reshape(n, t // rows, rows)
    key = np.broadcast_to(np.arange(t // rows, dtype=np.uint64), (n, t // rows)).copy()
    for k in range(rows):
        key = mix(key * STEPS[1] + parts[:, :, k])
    return key.view(np.int64)


def similar(a: bytes, b: bytes, percent: int = PERCENT) -> bool:
    """Whether 100 x intersection >= percent x union, on sorted sets without repeats."""
    a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, set size, 128-bit fingerprint of the set (null if empty), band keys, and 16 bits of each coordinate, for each row."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for texts in parts:
            sets = [shingle_set(t, hashes, words) for t in texts]
            full = [s for s in sets if len(s)]
            made = sketches(full) if full else ()
            both = iter(zip(band_keys(made), mix(made).astype("<u2")) if full else ())
            rows = [(len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), *next(both)) if len(s) else (0, None, None, None) for s in sets]
            out = pd.DataFrame(rows, columns=["n_shingles", "fingerprint", "bands", "sketch"])
            out["sketch"] = [None if x is None else x.tobytes() for x in out["sketch"]]
            yield out

    ready(docs.sparkSession)
    signed = batch_udf(run, "n_shingles long, fingerprint binary, bands array<long>, sketch binary")
    return docs.select("doc_id", signed("text").alias("_out")).select("doc_id", "_out.*")


def full_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "shingles": [shingle_set(t, hashes, words).tobytes() for t in f["text"]]})

    return docs.mapInPandas(run, "doc_id long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) with ok: whether the two full sets are similar."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"a": f["a"], "b": f["b"], "ok": [similar(x, y, percent) for x, y in zip(f["x"], f["y"])]})

    x = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInPandas(run, "a long, b long, ok boolean")


def with_blocks(members: DataFrame) -> DataFrame:
    """members (key, rep, root, and n_shingles if their sets go along) with the number of blocks of their key."""
    parts = [F.count("*") / BLOCK] + [8 * F.sum("n_shingles") / BLOCK_BYTES] * ("n_shingles" in members.columns)
    sizes = members.groupBy("key").agg(F.ceil(F.greatest(F.lit(1), *parts)).alias("blocks"))
    return members.join(sizes, "key")


def agreeing(members: DataFrame, agree: int, percent: int | None = None) -> DataFrame:
    """Distinct pairs a < b of members (key, rep, root, blocks, sketch) of one key, of different roots, whose sketches agree enough.

    With percent, members have their full sets (shingles) and all their keys (bands) too. Only pairs that are similar come out, fewer still
    where pairs before have already connected two roots; a pair of several keys is compared at the first of them. A key's members are dealt into
    blocks by hash, and every two blocks meet as one group of 2 x BLOCK rows or so: however large a key is, no task holds it whole, and pairs
    that don't agree aren't rows.
    """
    more = ["shingles", "bands"] if percent else []
    own = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    each = members.select("key", "rep", "root", "sketch", *more, own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    dealt = each.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "rep", "root", "sketch", *more)

    def compare(f: pd.DataFrame) -> list[tuple[int, int]]:
        own, rep, root = (f[c].to_numpy() for c in ("own", "rep", "root"))
        low, high, root = f["low"].iloc[0], f["high"].iloc[0], root.copy()
        data = np.frombuffer(b"".join(f["sketch"]), "<u2").reshape(len(rep), -1)
        sets, bands, key = (f["shingles"].tolist(), np.stack(f["bands"].tolist()), f["key"].iloc[0]) if percent else (None, None, None)
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        out = []
        for i in left:
            to = right[right > i] if low == high else right
            to = to[root[to] != root[i]]
            if not len(to):
                continue
            to = to[(data[to] == data[i]).sum(axis=1) >= agree]
            if sets and len(to):
                to = to[bands[i][(bands[to] == bands[i]).argmax(axis=1)] == key]
            for j in to:
                if sets:
                    if root[i] == root[j] or not similar(sets[i], sets[j], percent):
                        continue
                    root[root == root[j]] = root[i]
                out.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, names = None, ["key", "low", "high"]
        for f in chain(frames, [None]):
            if f is not None and not len(f):
                continue
            held = rest if f is None else f if rest is None else pd.concat([rest, f])
            if held is None or not len(held):
                return
            ids = held[names].to_numpy()
            cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1)]
            if f is None:
                cuts.append(len(held))
            pairs = [p for x, y in zip(cuts, cuts[1:]) if y - x > 1 for p in compare(held.iloc[x:y])]
            rest = held.iloc[cuts[-1] :]
            yield pd.DataFrame(pairs, columns=["a", "b"], dtype=np.int64)

    order = ["key", "low", "high"]
    return dealt.repartition(*order).sortWithinPartitions(*order).mapInPandas(run, "a long, b long").distinct()


class Scratch:
    """Tables in the shared folder, deleted together with the names that no later plan reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.n = spark, shared_folder(spark), 0

    def keep(self, df: DataFrame) -> tuple[DataFrame, str]:
        self.n += 1
        path = f"{self.base}/{self.n}"
        return stash(df, path), path


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root for each node of links (a, b): root is the least node of its component.

    Each round hooks every node to its least neighbour, then to that node's own, and contracts the links by these names:
    what falls together is gone from the next round, so rounds shrink fast. Each is a table in the shared folder.
    A hub's links meet partial minima, or joins that adaptive execution splits.
    """
    ordered = lambda df, a, b: df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a != b").distinct()
    edges, at = scratch.keep(ordered(links, "a", "b"))
    roots = None
    while True:
        hook = edges.union(edges.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("up"))
        jump, jump_at = scratch.keep(hook.join(hook.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", "top"))
        if roots is None:
            roots, roots_at = scratch.keep(jump.select("node", F.col("top").alias("root")))
        else:
            old = roots_at
            named = roots.join(jump.select(F.col("node").alias("root"), "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
            roots, roots_at = scratch.keep(named)
            forget(scratch.spark, old)
        top = lambda c: jump.select(F.col("node").alias(c), F.col("top").alias(f"t{c}"))
        left, left_at = scratch.keep(ordered(edges.join(top("a"), "a").join(top("b"), "b"), "ta", "tb"))
        forget(scratch.spark, at, jump_at)
        edges, at = left, left_at
        if not edges.limit(1).count():
            return roots


def merged(roots: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root after further links: only the components that they touch are worked on."""
    if roots is None:
        return components(links, scratch)
    root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    named = links.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    tops = components(named, scratch)
    moved = roots.join(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    fresh = tops.join(roots.select("node"), "node", "left_anti").select("node", "root")
    return scratch.keep(moved.union(fresh))[0]


def link_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, agree: int = AGREE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs (doc_id, text).

    Documents without words (null texts too) have no shingles and are their own components. Rows with a null doc_id link with
    nothing: component_id is null and kept true. Repeated rows of one id are one document. Other columns are ignored.

    Equal sets first become classes with their least doc_id as representative, so copies cost one row each. In each bucket
    of band keys with two representatives or more, all members are compared with the bucket's pivot, and confirmed pairs
    are merged into components. Where the other members of a bucket still span several components, they meet in
    blocks, full sets at hand: pairs of different components whose sketches agree enough are compared in full, within the task, each in the
    first bucket that it shares. This is the same for buckets of every size; only links between components become rows.
    """
    spark = ready(docs.sparkSession)
    scratch = Scratch(spark)
    slim = docs.select("doc_id", text_or_empty().alias("text"))
    signed, _ = scratch.keep(signatures(slim, words))
    known = signed.where("fingerprint IS NOT NULL AND doc_id IS NOT NULL")
    classes, _ = scratch.keep(known.groupBy("fingerprint").agg(F.min("doc_id").alias("rep")))
    # one row for each class; doc_id is unique, so the largest class is no hot key here
    reps = known.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    keyed = reps.select(F.col("doc_id").alias("rep"), "n_shingles", F.posexplode("bands").alias("band", "key"))
    shared, shared_at = scratch.keep(keyed.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("key"))
    members, _ = scratch.keep(keyed.join(shared, "key").select("key", "rep", "n_shingles", (F.col("band") % ORDERS).alias("turn")))
    forget(spark, shared_at)
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    sets, sets_at = scratch.keep(full_sets(slim.join(wanted, "doc_id", "left_semi").select("doc_id", "text"), words).dropDuplicates(["doc_id"]))

    least = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("rep", "turn"), "rep")).alias("least"))
    spent, _ = scratch.keep(least.select("key", F.col("least.rep").alias("pivot")))
    pairs = members.join(spent, "key").where("rep != pivot").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
    done, _ = scratch.keep(confirmed(pairs, sets, percent))
    roots = merged(None, done.where("ok").select("a", "b"), scratch)
    # every pair with a pivot is settled; the other members meet each other where several components are left among them
    others = members.join(spent, "key").where("rep != pivot").select("key", "rep", "n_shingles").distinct()
    state = others.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    state, _ = scratch.keep(state)
    open_, _ = scratch.keep(state.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("key"))
    still, _ = scratch.keep(state.join(open_, "key"))
    # the members of these buckets meet each other, full sets at hand
    coded = signed.select(F.col("doc_id").alias("rep"), "bands", "sketch").join(still.select("rep").distinct(), "rep", "left_semi").dropDuplicates(["rep"])
    full = with_blocks(still).join(coded, "rep").join(sets.select(F.col("doc_id").alias("rep"), "shingles"), "rep")
    found, _ = scratch.keep(agreeing(full, agree, percent))
    roots = merged(roots, found, scratch)
    forget(spark, sets_at)
    named = roots.select(F.col("node").alias("rep"), "root")
    groups, _ = scratch.keep(classes.join(named, "rep", "left").select("fingerprint", F.coalesce("root", "rep").alias("component_id")))
    out = signed.select("doc_id", "n_shingles", "fingerprint").join(groups, "fingerprint", "left")
    group = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", group.alias("component_id"), F.coalesce(F.col("doc_id") == group, F.lit(True)).alias("kept"))
