"""Word and shingle hashes against plain Python, whatever the segments."""

import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from liftloom.llm import words as W


def plain_words(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def plain_set(text):
    words = plain_words(text)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[n : n + 5]) for n in range(len(words) - 4)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab AB\n\té x", max_size=60)), max_size=12), st.sampled_from([7, 64, 1 << 20]))
def test_words_and_shingles(texts, segment):
    before, W.SEGMENT_BYTES = W.SEGMENT_BYTES, segment
    try:
        hashes, starts = W.word_hashes(*W.buffer_of(pa.array(texts, pa.string())))
        sets = list(W.shingle_sets(hashes, starts))
    finally:
        W.SEGMENT_BYTES = before
    known = {}
    for text, begin, end in zip(texts, starts, starts[1:]):
        words = plain_words(text)
        assert end - begin == len(words)
        for word, found in zip(words, hashes[begin:end]):
            assert known.setdefault(word, found) == found
    assert len(set(known.values())) == len(known)
    assert [len(s) for s in sets] == [len(plain_set(text)) for text in texts]


@pytest.mark.parametrize("most", [1, 10, 10**6])
def test_slices_hold_every_row(most):
    batch = pa.RecordBatch.from_arrays([pa.array(["abc", None, "", "d" * 50, "e"])], names=["text"])
    parts = list(W.slices(batch, "text", most))
    assert [v for part in parts for v in part.column("text").to_pylist()] == batch.column("text").to_pylist()
