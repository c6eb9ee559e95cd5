"""Ids beyond 2^53 beside nulls, repeated rows, null texts and columns of clashing names, in one batch, for every operator on documents."""

import public_tokenizers
import pytest

from duovox.llm import bpe, huffman, lines, media, near, packing, pii, quality, secrets

BIG = (1 << 60) + 1
ROWS = [(BIG, "one two three four five six\nseven 10.0.0.1"), (None, "a text without an id of its own"), (BIG + 1, "other words go here\nwith a line"), (BIG + 1, "other words go here\nwith a line"), (-BIG, None), (7, "")]
BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def docs(spark):
    clash = ["n_tokens", "start", "n_lines", "score", "component_id", "length", "spans", "_text", "_out", "payload_bytes", "label", "ids"]
    rows = [(i, t, *["x"] * len(clash)) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in clash)).coalesce(1)


def labels(spark):
    return spark.createDataFrame([(BIG, 1), (BIG + 1, 0), (None, 1), (-BIG, None)], "doc_id long, quality int")


@pytest.mark.parametrize(
    "run",
    [
        lambda s, d: quality.quality_scores(d, labels(s)), lambda s, d: quality.accepted(d, labels(s).limit(0)), lambda s, d: secrets.secret_spans(d), lambda s, d: secrets.redacted(d), lambda s, d: huffman.shard_digest(d, BYTES),
        lambda s, d: lines.line_digest(d), lambda s, d: lines.without_shared_lines(d), lambda s, d: pii.private_spans(d), lambda s, d: bpe.bpe_digest(d, BYTES), lambda s, d: bpe.bpe_columns(d, BYTES),
        lambda s, d: near.link_components(d), lambda s, d: packing.pack(d, WORDS), lambda s, d: media.media_digest(d),
    ],
)
def test_ids_come_back_whole(spark, docs, run):
    key = lambda v: (v is not None, v or 0)
    assert sorted((r.doc_id for r in run(spark, docs).collect()), key=key) == sorted((i for i, _ in ROWS), key=key)
    assert run(spark, docs.limit(0)).collect() == []


def test_components_of_big_ids(spark, docs):
    got = {(r.doc_id, r.component_id, r.kept) for r in near.link_components(docs).collect()}
    assert got == {(BIG, BIG, True), (BIG + 1, BIG + 1, True), (-BIG, -BIG, True), (7, 7, True), (None, None, True)}
