import math
import random
import zlib

import numpy as np

from duovox.llm import quality

SYLLABLES = ["th", "er", "in", "tion", "re", "an", "ou", "st", "ble", "de", "la", "eau"]


def word(rnd):
    return "".join(rnd.choice(SYLLABLES) for _ in range(rnd.randrange(1, 4)))


def prose(rnd, n):
    return " ".join(word(rnd) + rnd.choice(["", "", "", ",", "."]) for _ in range(n))


def junk(rnd, n):
    kind = rnd.randrange(4)
    words = prose(rnd, n).split()
    if kind == 0:
        return " | ".join(words)
    if kind == 1:
        return " ".join(w.upper() + "!!" for w in words)
    if kind == 2:
        return " ".join(w + rnd.choice(["***", "$$$", "###"]) for w in words)
    return " ".join(w for w in words[: n // 8 + 1] for _ in range(8))


def corpus(seed, n):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        good = int(rnd.random() < 0.8)
        rows.append((i, (prose if good else junk)(rnd, rnd.randrange(5, 200)), good))
    return rows


def test_held_out_accuracy_and_leakage(spark):
    rows = corpus(1, 600)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    held = [(i, q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r.held_out} == {i for i, _ in held}
    assert np.mean([got[i].predicted == q for i, q in held]) >= 0.97
    # the labels of held-out rows change nothing
    ids = {i for i, _ in held}
    other = spark.createDataFrame([(i, 1 - q if i in ids else q) for i, _, q in rows], "doc_id long, quality int")
    assert {r.doc_id: r.score for r in quality.quality_scores(docs, other).collect()} == {i: r.score for i, r in got.items()}


def test_edges(spark):
    rows = corpus(2, 200)
    docs = spark.createDataFrame([(None, None), (1000, ""), (1001, "word " * 50_000), (3, "x"), (3, "x")] + [r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == 205 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out is not None for r in got)
    assert quality.quality_scores(docs.limit(0), labels).collect() == []
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert all(r.predicted == 1 for r in quality.quality_scores(docs, labels.where("quality = 1")).collect())
    kept = quality.accepted(docs.withColumnRenamed("doc_id", "doc_id"), labels)
    assert kept.columns == ["doc_id", "text"] and 100 < kept.count() < 205


def test_sample_is_bounded_in_rows(spark):
    rnd = random.Random(4)
    rows = [(i, (prose if i % 2 else junk)(rnd, 20)) for i in range(1, 60)] + [(i, "copied words here") for i in (1, 2) for _ in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)] * 2, "doc_id long, quality int")
    known = {i for i in range(1, 60) if zlib.crc32(str(i).encode()) % 5}
    for bound in (20, 2000):
        got = quality.training_rows(docs, labels, bound).collect()
        assert len(got) == len({r.doc_id for r in got}) == min(bound, len(known)) and {r.doc_id for r in got} <= known
        assert {r.text for r in got if r.doc_id in (1, 2)} <= {min(t for j, t in rows if j == i) for i in (1, 2)}


def test_scores_against_a_plain_computation(spark):
    rows = corpus(6, 80)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    model = quality.fit(quality.training_rows(docs, labels))
    codes, used = quality.WordCodes(), [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    sets = {i: set(quality.features(t, codes).tolist()) for i, t, _ in rows}
    total = [quality.SIZE + sum(len(sets[i]) for i, _, q in used if q == k) for k in (0, 1)]

    def ratio(b):
        n = [1 + sum(b in sets[i] for i, _, q in used if q == k) for k in (0, 1)]
        return math.log(n[1] / total[1]) - math.log(n[0] / total[0])

    got = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    for i, grams in sets.items():
        x = {b: ratio(b) for b in grams}
        length = math.sqrt(sum(v * v for v in x.values()))
        margin = sum(float(model.weights[b]) * v / length for b, v in x.items()) + float(model.weights[-1])
        assert abs(got[i] - 1 / (1 + math.exp(-(model.a * margin + model.b)))) < 1e-4


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 12, 5)) for _ in range(60)]
    y = np.where([4 in r or rng.random() < 0.1 for r in rows], 1.0, -1.0)
    ratio = rng.normal(size=12)
    w = quality.descend(rows, y, np.ones(60), ratio, epochs=3000)
    x = np.zeros((60, 13))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.sqrt((ratio[r] ** 2).sum())
        x[i, 12] = 1
    cost = lambda v: v @ v / 2 + np.maximum(0, 1 - y * (x @ v)).sum()
    best = cost(w)
    for _ in range(2000):
        assert cost(w + rng.normal(size=13) * 0.02) >= best - 0.02


def test_ratio_against_plain_counts(spark):
    rows = [(1, "aa bb", 1), (2, "aa", 1), (3, "cc aa", 0)]
    model = quality.fit(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    codes = quality.WordCodes()
    sets = {i: set(quality.features(t, codes).tolist()) for i, t, _ in rows}
    total = [sum(len(sets[i]) for i, _, q in rows if q == k) + quality.SIZE for k in (0, 1)]
    for b in set().union(*sets.values()):
        n = [sum(b in sets[i] for i, _, q in rows if q == k) + 1 for k in (0, 1)]
        assert abs(model.ratio[b] - (np.log(n[1] / total[1]) - np.log(n[0] / total[0]))) < 1e-5
