import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from duovox.llm.chunks import key_table, spaced_chunks
from duovox.llm.tokens import LibraryEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
SOURCE = open(PATH, encoding="utf-8").read()
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = LibraryEncoder(SOURCE, cache=50)
PIECES = ["word", "Äpfel", "ß", "漢", " ", "\n", "\0", "\xa0", "<|endoftext|>", "endoftext", "|>", "$$$", ".", "'s", "'", "12", "!!"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=8).map("".join), max_size=6))
def test_batches_encode_as_the_library_does(texts):
    got = [i.tolist() for i in ENCODER.encode_batch(texts)]
    assert got == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


class Recorder:
    def __init__(self, library):
        self.library, self.whole = library, []

    def encode(self, *a, **b):
        return self.library.encode(*a, **b)

    def encode_batch_fast(self, texts, **b):
        self.whole += texts
        return self.library.encode_batch_fast(texts, **b)


def test_signs_after_a_word_do_not_send_it_through_the_library():
    encoder = LibraryEncoder(SOURCE)
    encoder.library = Recorder(encoder.library)
    texts = ["Ones anthing anthing### anthing!!", "a  anthing", "and anthing*** anthing a.b"]
    got = [i.tolist() for i in encoder.encode_batch(texts)]
    assert got == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert sorted(encoder.library.whole) == ["  anthing", " a.b"]


def test_keys_are_distinct_and_stay_in_order():
    texts = ["a b a", "", "a  b", "b\nb"]
    keys, place, ends = key_table(texts, spaced_chunks, True)
    assert len(keys) == len(set(keys))
    found = [keys[k] for k in place]
    assert [found[a:b] for a, b in zip([0, *ends], ends)] == [spaced_chunks(t) for t in texts]


def test_an_added_token_of_letters_and_signs_stays_whole():
    source = Tokenizer.from_file(PATH)
    source.add_tokens(["C++"])
    (got,) = LibraryEncoder(source.to_str()).encode_batch(["in C++ or D++"])
    assert got.tolist() == source.encode("in C++ or D++", add_special_tokens=False).ids
