import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from duovox.llm import packing
from duovox.llm.tokens import LibraryEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["", " ", "Don't STOP it's", "ÉCOLE İstanbul ΣΑΣ ς", "a\x1cb c", "x\x85y z", "12 345 ½", "<|startoftext|> a<|endoftext|>b", "<|ENDOFTEXT|>", "Å é", "word.\n\nword, !!word?!", "́x", "ﬁ Ǆ"]


@pytest.mark.parametrize("text", ODD)
def test_cached_chunks_encode_as_the_library_does(text):
    (got,) = LibraryEncoder(open(PATH, encoding="utf-8").read()).encode_batch([text])
    assert got.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


ENCODER = LibraryEncoder(open(PATH, encoding="utf-8").read(), cache=50)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aB'sTΣİé \n\t.,1é漢\xa0\x1f<|>"), max_size=25))
def test_any_text_encodes_as_the_library_does(text):
    (got,) = ENCODER.encode_batch([text])
    assert got.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def filled(counts, size):
    slots = packing.plan(counts, size)
    used = defaultdict(list)
    by = defaultdict(list)
    for n, first, sequence, offset in slots.tolist():
        by[n].append((first, sequence, offset))
    for n, c in counts.items():
        s = sorted(by[n])
        for k, (first, sequence, offset) in enumerate(s):
            end = s[k + 1][0] if k + 1 < len(s) else c
            for r in range(first, end):
                used[sequence + r - first].append((offset, n))
    for items in used.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= size
    assert Counter(n for items in used.values() for _, n in items) == Counter({n: c for n, c in counts.items() if c})
    return len(used)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=20))
def test_plan_places_every_piece_without_gaps(counts):
    filled(counts, 30)


def test_pair_beats_greedy():
    # greedy puts 5 beside 6 (one cell left over); 3 + 3 fills the bin
    assert filled({6: 1, 5: 1, 3: 2}, 12) == 2
    assert packing.best_pair(np.array([0, 0, 0, 2, 0, 0, 0]), 6) == (3, 3)
    assert packing.best_pair(np.array([0, 0, 0, 1, 0, 0, 0]), 6) is None


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(0)
    n = np.clip(rng.lognormal(6, 1, 20_000).astype(int), 1, 2048)
    bins = filled(Counter(n.tolist()), 2048)
    assert bins <= 1.002 * -(-n.sum() // 2048) + 1


def test_table(spark):
    rows = [(1, "a b c " * 1500), (2, None), (3, ""), (4, "x y"), (4, "x y"), (None, "Z")] + [(i, "w " * (i % 97)) for i in range(5, 300)]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, length string").repartition(6)
    got = packing.pack(docs, PATH).collect()
    want = Counter()
    for i, t in rows:
        ids = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[i, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for items in by.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(by) == -(-sum(r.length for r in got) // 2048)
    assert packing.pack(docs.limit(0), PATH).collect() == []
