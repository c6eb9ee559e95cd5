import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from duovox.llm.bpe import ByteBPE, bpe_columns, bpe_digest
from duovox.llm.chunks import literal, spaced_chunks

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
BPE = ByteBPE(open(PATH, encoding="utf-8").read())
ODD = ["", " ", "  ", "\n\n\n", "a  b", "a \n b", " lead", "\n lead\n", "tail \n", "aaaaaaaaaaa aaaa", "it's we'll 'S", "x\t\ty", "\0 \0a", "\x85\xa0 　z", "<|endoftext|>", "a <|endoftext|>b  <|endoftext|>", "été ßü 漢字 १२ ½", "1234567 a1b2", "a\x1c\x1db", "word." * 3000, "!!!???... --", "́x", "🙂🙂 x"]


def same(text):
    (ids, said), = BPE.encode_batch([text])
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want, text
    assert said == ",".join(map(str, want))
    assert BPE.decode(ids) == LIBRARY.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts_encode_as_the_library_does(text):
    same(text)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab'st \n\t.,1é漢\xa0 <|>"), max_size=30))
def test_any_text_encodes_as_the_library_does(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab \n\t.\xa0\x1c\0"), max_size=20))
def test_chunks_join_to_the_text(text):
    assert "".join(map(literal, spaced_chunks(text))) == text


def test_decode_replaces_broken_bytes_as_the_library_does():
    ids = LIBRARY.encode("漢字 é", add_special_tokens=False).ids
    for cut in (ids[1:], ids[:-1], ids[::-1], [50256, *ids]):
        import numpy as np

        assert BPE.decode(np.array(cut)) == LIBRARY.decode(cut, skip_special_tokens=False)


def test_small_cache_changes_nothing():
    small = ByteBPE(open(PATH, encoding="utf-8").read(), cache=3)
    texts = ["the cat sat", "on the mat the", "cat sat on", "the cat"] * 3
    for got, text in zip([*small.encode_batch(texts[:4]), *small.encode_batch(texts[4:8]), *small.encode_batch(texts[8:])], texts):
        assert got[0].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_table(spark):
    rows = [(1, "a b"), (None, "a b"), (2, None), (2, None), (3, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_tokens string")
    got = bpe_digest(docs, PATH).collect()
    assert len(got) == 5 and sorted(r.n_tokens for r in got) == [0, 0, 0, 2, 2]
    assert {r.decoded_sha256 for r in got if r.n_tokens == 0} == {hashlib.sha256(b"").hexdigest()}
    assert bpe_digest(docs.limit(0), PATH).collect() == []
    assert {r.decoded for r in bpe_columns(docs, PATH).collect()} == {"a b", ""}
