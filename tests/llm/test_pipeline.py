import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from duovox.llm import quality
from test_lines import brute as line_brute
from test_near import brute as near_brute
from test_quality import junk, prose
from test_secrets import base


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with junk, shared lines, near copies, secrets and an empty text."""
    rnd = random.Random(8)
    line = "all rights reserved by the owners of this text"
    rows, labels = [], []
    for i in range(240):
        good = rnd.random() < 0.8
        text = (prose if good else junk)(rnd, rnd.randrange(30, 120))
        if i % 9 == 0:
            text += f"\n{line}\nlast words {i}"
        if good and i % 11 == 0:
            text += f' token = "{rnd.getrandbits(160):040x}" end'
        rows.append((i, text))
        labels.append((i, int(good), 0))
        if good and i % 8 == 0:
            words = text.split(" ")
            words[len(words) // 2] = "changed"
            rows.append((1000 + i, " ".join(words)))
    rows += [(5000, ""), (5001, None)]
    base_path = tmp_path_factory.mktemp("pipeline")
    docs = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(base_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(base_path / "labels.parquet"))
    return str(base_path)


def rows_of(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def test_each_stage_against_brute_force(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    before, columns = docs, docs.columns
    results = []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, before, folder).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        results.append((before, out))
        before = out
        if k < 4:
            assert out.columns == columns
    start, kept = rows_of(results[0][0]), rows_of(results[0][1])
    wrong = [i for i in start if i in labels and (i in kept) != bool(labels[i])]
    assert len(wrong) <= 0.02 * len(labels) and all(start[i] == kept[i] for i in kept)

    before, after = map(rows_of, results[1])
    import hashlib

    want = {i: h for i, _, _, h in line_brute(list(before.items()))}
    assert {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in after.items()} == want
    assert all(r.n_chars == len(r.text or "") for r in results[1][1].collect())

    before, after = map(rows_of, results[2])
    groups = {i: keep for i, _, _, keep in near_brute(list(before.items()))}
    assert after == {i: t for i, t in before.items() if groups[i]} and len(after) < len(before)

    before, after = map(rows_of, results[3])
    for i, text in before.items():
        spans = base(text)
        assert (after[i] == text) if not spans else ("[SECRET]" in after[i] and not base(after[i]))

    pieces = results[4][1]
    assert {r.doc_id for r in pieces.collect()} == set(after)
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("e")).where("n > 2048 OR n != e").count() == 0


def test_near_stage_keeps_one_row_of_a_document(spark, folder):
    a, b, c = (" ".join(f"{name}{i}" for i in range(30)) for name in "abc")
    rows = [(1, a, "x"), (1, a, "x"), (1, a, "w"), (2, a, "x"), (3, b, "x"), (None, c, "y"), (None, c, "x"), (None, b, "x"), (None, "", "x"), (None, "", "x"), (None, None, "x"), (4, None, "x")]
    docs = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = pipeline.near_stage(spark, docs, folder)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text, r.source) for r in out.collect()), key=str)
    assert got == sorted([(1, a, "w"), (3, b, "x"), (4, None, "x"), (None, c, "x"), (None, b, "x"), (None, "", "x"), (None, "", "x"), (None, None, "x")], key=str)


def test_run_gives_the_last_stage(spark, folder):
    out = pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 100


def test_classifier_learns_only_from_rows_that_are_not_held_out(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    used = quality.training_rows(docs, labels)
    assert used.where("crc32(cast(doc_id AS string)) % 5 = 0").count() == 0 and used.count() > 150


def test_edges_of_all_stages(spark, folder):
    """Null and repeated ids, null, empty and long texts, columns with the names that the operators use, and empty tables."""
    real = spark.read.parquet(f"{folder}/documents.parquet").limit(40).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, 99, 88, "s", 0.5) for r in real]
    text = real[0].text
    rows += [(None, t, None, None, None, 1, 2, None, None) for t in (None, "", text, text, "word " * 60_000)] + [rows[1]] * 2 + [(10**17 + 1, None, "en", "x", 0, 7, 7, "s", 1.0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_lines int, n_dropped int, _text string, _score double"
    docs = spark.createDataFrame(rows, schema).repartition(4)
    for name, stage in pipeline.STAGES:
        empty = stage(spark, docs.limit(0), folder)
        assert empty.collect() == [], name
        out = stage(spark, docs, folder)
        got = out.collect()
        if name == "packing":
            assert len({(r.doc_id, r.sequence_id, r.offset) for r in got}) == len(got) >= len(rows) and 10**17 + 1 in {r.doc_id for r in got}
            continue
        assert out.columns == docs.columns, name
        own = {(r[0], *r[5:]) for r in rows}
        assert {(r.doc_id, *r[5:]) for r in got} <= own, name  # other columns as they were, clashing names too
        if name in ("line dedup", "secret scan"):
            assert len(got) == len(rows) and sum(r.text is None for r in got) == sum(r[1] is None for r in rows)
            assert all(r.n_chars == len(r.text) for r in got if r.text is not None)
    unlabelled = spark.createDataFrame([(-5, "a b c", "en", "x", 5), (None, None, "en", "x", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert pipeline.quality_stage(spark, unlabelled, folder).count() == 2
