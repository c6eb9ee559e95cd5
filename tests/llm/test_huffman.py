import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from duovox.llm import huffman

PATH = public_tokenizers.path("byte_bpe_50k.json")


def kraft(lengths):
    return sum(2.0 ** -int(n) for n in lengths if n)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=60))
def test_lengths_are_a_complete_code_within_the_limit(counts):
    got = huffman.code_lengths(np.array(counts), 7)
    assert got.max() <= 7 and ((got > 0) == (np.array(counts) > 0)).all()
    if (got > 0).sum() > 1:
        assert kraft(got) == 1


def test_lengths_without_pressure_are_as_short_as_plain_huffman():
    import heapq

    counts = np.array([int(1.5**k) for k in range(20)])
    heap, cost = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    assert (huffman.code_lengths(counts, 30) * counts).sum() == cost
    with pytest.raises(ValueError):
        huffman.code_lengths(counts, 4)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 700), min_size=1, max_size=8), st.integers(1, 4000), st.randoms())
def test_blocks_round_trip(sizes, vocabulary, rnd):
    rng = np.random.default_rng(rnd.randint(0, 10**6))
    counts = np.array([s + 1 for s in sizes])
    ids = (vocabulary * rng.random(counts.sum()) ** 4).astype(np.uint16)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=vocabulary), 14)
    data, cuts, marks = huffman.encode(ids, counts, lengths, huffman.canonical_codes(lengths))
    assert len(marks) == sum(-(-c // huffman.STEP) for c in counts) and cuts[-1] == len(data)
    got = huffman.Decoder(lengths).block(data, counts, marks.astype("<u4").tobytes())
    assert (got == ids).all()


def check(spark, rows, **more):
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, start int").repartition(3)
    got = [tuple(r) for r in huffman.shard_digest(docs, PATH, **more).collect()]
    library, want, start = Tokenizer.from_file(PATH), [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want


def test_table(spark):
    check(spark, [(5, "a b"), (3, None), (2, ""), (9, "word " * 70_000), (None, "x"), (4, "漢字 <|endoftext|>"), (7, "a b"), (7, "a b")])


def test_one_id_and_none(spark):
    check(spark, [(1, None), (2, "")])
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert huffman.shard_digest(docs, PATH).collect() == []


def test_many_files_keep_order(spark, tmp_path):
    rows = [(i * 7 % 1000, f"text {i} " * (i % 13)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    huffman.write_shards(docs, PATH, str(tmp_path / "s"), file_ids=1500)
    got = sorted(huffman.shard_ids(spark, str(tmp_path / "s")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(i for i, _ in rows)
    assert spark.read.parquet(str(tmp_path / "s/blocks")).select("file").distinct().count() > 2
    library = Tokenizer.from_file(PATH)
    text, start = dict(rows), 0
    for r in got:
        assert r.start == start and r.ids == [*library.encode(text[r.doc_id]).ids, 0]
        start += len(r.ids)
