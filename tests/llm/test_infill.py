import hashlib
import random

import pytest

from duovox.llm import infill


def plain(doc_id, text):
    """n, form, prefix, middle and output by slices of the text."""
    text = text or ""
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def texts():
    rnd = random.Random(5)
    wide = "".join(rnd.choice("abc \né中\U0001f600") for _ in range(60_000))
    line = "The same long passage, with é and 中, that many documents hold. " * 40
    many = [line[rnd.randrange(200) :] + "".join(rnd.choice("xyz ") for _ in range(rnd.randrange(900))) for _ in range(40)]
    return [None, "", "a", "é", "<P>", "x<S>y", "<", "<<P", "ab<M", "\U0001f600" * 9000, "a" * 50_000, wide, line, line, "q" * 300 + "<M>" + "q" * 900, *many]


def test_against_slices(spark):
    rows = [(i if i != 12 else None, t, "x", -1) for i, t in enumerate(texts())] + [(3, "again", "x", -1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n int").repartition(3)
    got = infill.with_infill(docs).collect()
    want = sorted(((i, *plain(i, t)) for i, t, *_ in rows), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want
    digests = infill.infill_digest(docs).collect()
    assert sorted((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256) for r in digests if r.doc_id is not None) == sorted((i, n, f, a, b, hashlib.sha256(o.encode()).hexdigest()) for i, n, f, a, b, o in want if i is not None)
    assert sorted(r.restored_sha256 for r in digests) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t, *_ in rows)
    assert infill.with_infill(docs.limit(0)).collect() == [] == infill.infill_digest(docs.limit(0)).collect()
    assert {"plain", "psm", "spm"} == {r.form for r in got}


def test_chunks_are_shared_and_bounded():
    rnd = random.Random(1)
    shared = bytes(rnd.randrange(97, 123) for _ in range(20_000))
    one, two = b"a different start" + shared, shared[37:] + b"end"
    pieces = []
    for data in (one, two, b"a" * 100_000, b""):
        ends = infill.chunk_ends(data)
        cuts = [data[a:b] for a, b in zip([0, *ends], ends)]
        assert b"".join(cuts) == data and all(len(c) <= infill.MOST for c in cuts) and all(len(c) >= infill.LEAST for c in cuts[:-1])
        pieces.append(set(cuts))
    assert sum(map(len, pieces[0] & pieces[1])) > 0.8 * len(shared)
    cache = infill.Summaries()
    infill.Measured(one, cache)
    before = cache.hits
    infill.Measured(two, cache)
    assert cache.hits > before


def test_marks_across_chunks_and_cache_checks_content(monkeypatch):
    for lead in range(240, 270):
        for mark in ("<P>", "<S>", "<M>"):
            assert infill.Measured(("z" * lead + mark + "y" * 500).encode(), infill.Summaries()).marked
    assert not infill.Measured(("z<" * 800 + "P >").encode(), infill.Summaries()).marked
    monkeypatch.setattr(infill.xxhash, "xxh3_64_intdigest", lambda data: 7)  # all contents collide
    cache = infill.Summaries(limit=600)
    for text in ("é" * 400, "a" * 400, "é" * 400, "b<P>" * 100, "a" * 9000):
        m = infill.Measured(text.encode(), cache)
        assert (m.length, m.marked) == (len(text), "<P>" in text)
        assert [m.offset(k) for k in (0, 1, len(text) // 2, len(text))] == [len(text[:k].encode()) for k in (0, 1, len(text) // 2, len(text))]


@pytest.mark.parametrize("form", ["plain", "psm", "spm"])
def test_rebuilt(form):
    for p, m, s in [("", "", ""), ("a<", "<S", ">b"), ("<P", "M>", "<"), ("<S", "<M", "<P")]:
        whole = p + m + s
        out = {"plain": whole, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        assert infill.rebuilt(out.encode(), form) == whole.encode()
