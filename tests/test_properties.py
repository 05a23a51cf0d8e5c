"""Properties over arbitrary texts."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.functions.markdown import parse_markdown
from corpusmill.operators.chunking import split_text
from corpusmill.params import Params

SMALL = Params(chunk_size=20, chunk_overlap=5)
separators = st.lists(st.sampled_from([" ", "  ", "\n", "\n\n", "。", "!", "? ", "! ", "\n\n\n"]), max_size=60)


@settings(max_examples=200, deadline=None)
@given(separators)
def test_chunks_are_short_and_cover_the_text(marks):
    words = [f"w{k}x" for k in range(len(marks))]
    parts = split_text("".join(w + m for w, m in zip(words, marks, strict=True)), SMALL)
    assert all(0 < len(p) <= SMALL.chunk_size and p == p.strip() for p in parts)
    seen = [[int(n) for n in re.findall(r"w(\d+)x", p)] for p in parts]
    assert sorted({n for s in seen for n in s}) == list(range(len(words)))
    assert all(s == list(range(s[0], s[-1] + 1)) for s in seen if s)
    firsts = [s[0] for s in seen if s]
    assert firsts == sorted(firsts)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="#*_`>-+1.| \n[]()!~<a", max_size=80))
def test_markdown_takes_anything(text):
    plain, toc = parse_markdown(text)
    assert isinstance(plain, str) and all(path.endswith(t) for _, t, path in toc)
