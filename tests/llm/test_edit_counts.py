"""Counts after edits equal counts of the edited text from scratch."""

from hypothesis import given, settings
from hypothesis import strategies as st

import tagweave.llm.edit_counts as E
from tagweave.llm.tokens import public_path

COUNTER = E.Counter(public_path(E.TOKENIZER))
PARTS = ["the ", "we'll", "'", "ll", " ", "  ", "\n", "abc", "12", "!?", "é", "日本", "<|endoftext|>", "I've", "\t", " a", " \n", "\n ", "\x1c", "\xa0"]
text = st.lists(st.sampled_from(PARTS), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(text, st.lists(st.tuples(st.integers(-3, 120), st.integers(-3, 140), text), max_size=5))
def test_edits(start, edits):
    old, E.LEAF = E.LEAF, 4
    try:
        tree = E.SegmentTree(start, COUNTER)
        plain = start
        for a, b, r in edits:
            tree.edit(a, b, r)
            a = min(max(0, a), len(plain))
            plain = plain[:a] + r + plain[min(max(a, b), len(plain)) :]
            assert tree.text == plain
            want = COUNTER.encoder.tokenizer.encode(plain, add_special_tokens=False).ids
            assert tree.totals == (len(plain), len(E._SPLIT.findall(plain)), len(want))
    finally:
        E.LEAF = old
