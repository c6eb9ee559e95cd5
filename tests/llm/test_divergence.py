import random
import re
from collections import Counter, defaultdict


from duovox.llm import divergence


def plain(rows, ranks=200):
    """The contract's rows by loops over every kept term."""
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df, counts = Counter(), defaultdict(Counter)
        for one, source, words in docs:
            if one == lang:
                df.update(set(words))
                counts[source].update(words)
        kept = [w for w in df if df[w] >= 3]
        total = Counter({w: sum(c[w] for c in counts.values()) for w in kept})
        p = lambda c: {w: 1 + 1_000_000_000 * (c[w] + 1) // (sum(c[x] for x in kept) + len(kept)) for w in kept}
        own, q = {s: p(c) for s, c in counts.items()}, p(total)
        f = lambda a, b: (a - b) * (a - b) // b
        for s in counts:
            pairs = [(sum(f(own[s][w], own[o][w]) for w in kept), o) for o in counts if o != s]
            terms = [(f(own[s][w], q[w]), w) for w in kept if counts[s][w] and own[s][w] > q[w]]
            for part, found in (("pair", pairs), ("term", terms)):
                for k, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))):
                    if part == "pair" or k < ranks:
                        out.append((lang, s, part, item, v, k + 1))
    return sorted(out)


def rows():
    rnd = random.Random(3)
    words = ["Alpha", "beta", "été", "中文", "it's", "x1y", "\U0001f600", "zeta_eta", *(f"w{a}{b}" for a in "abcdefgh" for b in "abcdefgh")]
    out = []
    for k in range(240):
        lang = [None, "", "en", "en", "de"][k % 5]
        source = [None, "s1", "s2", "hot", "hot", "hot"][rnd.randrange(6)]
        size = int(rnd.paretovariate(1)) % 80
        out.append((lang, source, " ".join(words[min(len(words) - 1, int(rnd.expovariate(0.08)))] for _ in range(size))))
    out += [("fr", "only", "one two"), ("fr", "other", None), ("fr", "third", "123 !?"), ("it", "alone", "a a a"), ("it", "alone", "a b"), ("it", "alone", "a")]
    return out + [out[3]] * 4 + [("en", "long", "Beta gamma " * 20_000)]


def test_against_loops(spark):
    data = rows()
    docs = spark.createDataFrame([(*r, 1, "t") for r in data], "lang string, source string, text string, value int, term string").repartition(5)
    got = divergence.source_divergence(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == plain(data)
    short = divergence.source_divergence(docs, ranks=2).collect()
    assert sorted(tuple(r) for r in short) == plain(data, 2)
    assert divergence.source_divergence(docs.limit(0)).collect() == []


def test_bounded_arrays_and_flushes_give_the_same(spark, monkeypatch):
    frames = [(lang, [(s, p, 5) for s, p in e]) for lang, e in [("a", [("x", 9), ("y", 40), ("z", 7)]), ("a", [("x", 11)]), ("b", [("y", 6), ("x", 90)]), ("a", [("z", 12), ("y", 8)])]]
    df = spark.createDataFrame(frames, "lang string, entries array<struct<source string, p long, p0 long>>").coalesce(1)
    want = defaultdict(int)
    for lang, e in frames:
        for s, p, p0 in e:
            for o, q, q0 in e:
                if s != o:
                    f = lambda a, b: (a - b) ** 2 // b
                    want[lang, s, o] += f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)
    for chunk, held in ((1 << 20, 200_000), (3, 1)):
        monkeypatch.setattr(divergence, "CHUNK", chunk)
        monkeypatch.setattr(divergence, "HELD", held)
        got = divergence.shared_pairs(df).groupBy("lang", "source", "item").sum("value").collect()
        assert {tuple(r[:3]): r[3] for r in got} == want


def test_counts_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    one = spark.createDataFrame([(10**15, 3 * 10**15, 10**6)], "c long, n long, v long").select(divergence.scaled(F.col("c"), F.col("n"), F.col("v")).alias("p")).first()
    assert one.p == 1 + 10**9 * (10**15 + 1) // (3 * 10**15 + 10**6)
    assert divergence.sparse_vector("A a-b Éé".encode()) == {b"a": 2, b"b": 1, "Éé".encode(): 1}
