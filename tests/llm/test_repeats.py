import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from duovox.llm import repeats


def plain(texts, size):
    """n_words, n_removed and what stays, from all windows as tuples."""
    split = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + size]) for w in split for i in range(len(w) - size + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def corpus():
    rnd = random.Random(9)
    word = lambda: rnd.choice("abcdefghij") + rnd.choice("klmnopé中")
    text = lambda n: [word() for _ in range(n)]
    passages = [text(n) for n in (34, 35, 36, 50, 70, 200)]
    docs = []
    for k in range(120):
        w = text(rnd.randrange(0, 120))
        for p in rnd.sample(passages, rnd.randrange(0, 3)):
            at = rnd.randrange(len(w) + 1)
            w[at:at] = p
        if k % 5 == 0 and docs:  # a near copy
            w = docs[-1].split()
            for _ in range(3):
                if w:
                    w[rnd.randrange(len(w))] = word()
        docs.append(rnd.choice([" ", "\n", " \t", "\x0b"]).join(w))
    a, b = text(40), text(40)
    edges = [" ".join(text(20) + a[:36]), " ".join(a + b), " ".join(b[-36:] + text(20)), " ".join(a[20:] + b[:20])]
    return [None, "", "  \n ", "one", docs[7], docs[7], *docs, *edges, "x " * 400, "x " * 34, "p q r " * 60, " ".join(text(60) * 2), " ".join(text(30_000) + passages[3])]


def test_against_all_windows(spark):
    texts = corpus()
    rows = [(i if i % 50 != 3 else None, t, -7, "z") for i, t in enumerate(texts)] + [(9, texts[9], -7, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, n_words string").repartition(7)
    got = repeats.without_repeats(docs)
    kept = got.collect()
    want = plain([r[1] for r in rows], 35)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in kept) == Counter((r[0], *w) for r, w in zip(rows, want))
    assert sum(r.n_removed for r in kept) > 3000
    words = {r.row: (next(t for i, t, *_ in rows if i == r.doc_id and len((t or "").encode().split()) == r.n_words) or "").encode().split() for r in kept if r.doc_id is not None}
    for r in kept:
        last = -1
        for f in r.factors:
            assert f.length >= 35 and f.start > last
            last = f.start
            if r.doc_id is not None and f.row in words:  # a factor is what stands at its home
                assert words[r.row][f.start : f.start + f.length] == words[f.row][f.place : f.place + f.length]
    digest = repeats.repeats_digest(docs)
    assert digest.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"] and digest.count() == len(rows)
    assert repeats.without_repeats(docs.limit(0)).collect() == []


@pytest.mark.parametrize(("words", "gram"), [(5, 2), (4, 4), (6, 1)])
def test_short_windows_and_string_ids(spark, words, gram):
    rnd = random.Random(words)
    texts = [" ".join(rnd.choice("abc") for _ in range(rnd.randrange(60))) for _ in range(12)]
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in repeats.without_repeats(docs, words, gram).collect()}
    assert [got[f"d{i}"] for i in range(len(texts))] == plain(texts, words)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=6, max_size=80), st.sampled_from([(6, 2), (6, 3), (5, 5)]))
def test_blocks_cut_by_content(values, sizes):
    words, gram = sizes
    x = repeats.mix(np.array(values, np.uint64))
    anchor, a, b, start, count = repeats.blocks(x, words, gram)
    assert start[0] == 0 and (start[1:] == (start + count)[:-1]).all() and start[-1] + count[-1] == len(values) - words + 1
    assert count.max() <= words - gram + 1
    grams = repeats.rolled(x, gram, 2)
    names = {}
    for k in range(len(start)):
        content = tuple(values[start[k] : start[k] + count[k] + words - 1])
        assert names.setdefault(content, (anchor[k], a[k], b[k])) == (anchor[k], a[k], b[k])
        for s in range(start[k], start[k] + count[k]):
            part = grams[s : s + words - gram + 1]
            high = part >> np.uint64(24)
            assert grams[s + np.flatnonzero(high == high.min())[-1]].view(np.int64) == anchor[k]
    assert len(set(names.values())) == len(names)


def test_long_searches_are_cut(monkeypatch):
    x = repeats.mix(np.arange(1000, dtype=np.uint64) % np.uint64(7))
    whole = repeats.blocks(x)
    monkeypatch.setattr(repeats, "PIECE", 64)
    assert all((u == v).all() for u, v in zip(whole, repeats.blocks(x)))


def test_factors_grow_at_their_home():
    assert repeats.factors([(0, 3, 8, 20), (3, 2, 8, 23), (5, 1, 8, 40), (9, 1, 8, 44)], 35) == [(0, 39, 8, 20), (5, 35, 8, 40), (9, 35, 8, 44)]
    assert repeats.factors([], 35) == []
