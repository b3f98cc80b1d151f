"""Chunk-wise encoding equals the library's encoding of whole texts."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tagweave.llm.tokens import Encoder, Kept, public_path

NAMES = ("byte_bpe_50k.json", "word_bpe_49k.json")
HELD = {n: (Tokenizer.from_file(public_path(n)), Encoder(public_path(n), keep=50)) for n in NAMES}
PARTS = ["the", " ", "  ", "\n", "\n\n", " \n", "\t", "It's", "don't", "<|endoftext|>", "<|startoftext|>", "é", "é", "́", "12", "!!", "\xa0", "\x01", "ΑΣ", "日本", "\x85", "\r\n", "'", "ll", "I", " "]


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=600, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), min_size=1, max_size=4))
def test_equals_whole_texts(name, texts):
    tokenizer, encoder = HELD[name]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    ids, ends = encoder.encode(pa.array([*texts, None]), np.array([7], "<u4").tobytes())
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [[*w, 7] for w in [*want, []]]
    ids, ends = encoder.encode(pa.array(texts).slice(1))
    assert ids.tolist() == [i for w in want[1:] for i in w] and len(ends) == len(texts) - 1


FORMS = ["Ab", "aB", "ÀÉ", "ß", "ẞ", "Ÿ", "ÿ", "ª", "µ", "×", "K", "İ", "́", ".", "%%%", "'", "'s", "-", "<", "|", "<|endoftext|>", "7", "\x7f", " ", "\n"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.lists(st.sampled_from(FORMS), max_size=9).map("".join), min_size=1, max_size=4))
def test_letters_and_marks_equal_whole_texts(texts):
    tokenizer, encoder = HELD["word_bpe_49k.json"]
    ids, ends = encoder.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_forms_of_a_word_are_kept_once():
    encoder = Encoder(public_path("word_bpe_49k.json"))
    encoder.encode(pa.array(["Word word, WORD!? word... word", "Wörd wörd; word wörd%%%"]))
    keys = [k for x in vars(encoder).values() if isinstance(x, Kept) for k in x.new]
    assert sorted(k for k in keys if k.isalpha()) == ["word", "wörd"] and not {"word,", "Word", "WORD!?", "wörd%%%"} & set(keys)
