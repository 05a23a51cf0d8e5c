"""Properties over arbitrary texts and bytes."""

import functools

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import pii, sentencepieces, warc


@functools.cache
def pieces():
    import sentencepiece

    path = sentencepieces.default_model()
    return sentencepieces.Bpe(path), sentencepiece.SentencePieceProcessor(model_file=path)


plain = st.characters(exclude_categories=("Cs",))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(plain, st.sampled_from("  \n▁the aeiß")), max_size=120), max_size=6))
def test_encoding_is_that_of_the_library(texts):
    own, lib = pieces()
    for text, (ids, n, decoded) in zip(texts, own.encode(texts), strict=True):
        want = lib.encode(text, add_eos=True)
        assert ids == " ".join(map(str, want)) and n == len(want) and decoded.decode() == lib.decode(want)


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="abth e", min_size=300, max_size=900).map(lambda t: t.replace(" ", "")))
def test_long_words_too(word):
    own, lib = pieces()
    ((ids, _, _),) = list(own.encode([word]))
    assert ids == " ".join(map(str, lib.encode(word, add_eos=True)))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=plain, max_size=300), st.integers(1, 50), st.integers(5, 60))
def test_framing_and_segments_round_trip(text, chunk, segment):
    payload = text.encode()
    assert warc.dechunked(warc.chunked(payload, max(chunk, 4))) == payload
    parts = warc.segments(payload, segment)
    assert b"".join(parts) == payload and all(len(p) <= segment for p in parts)
    for p in parts:
        p.decode()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="a1@.+- ()é", max_size=60))
def test_base_spans_lie_in_order(text):
    spans = pii.base_spans(text)
    for kind in pii.KINDS:
        own = [(a, b) for k, a, b in spans if k == kind]
        assert all(a < b for a, b in own) and all(b <= c for (_, b), (c, _) in zip(own, own[1:], strict=False))
