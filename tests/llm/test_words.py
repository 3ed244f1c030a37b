import random

import pyarrow as pa
import pytest

from tests.llm.data import ALNUM, SPACED, words
from wattloom.llm import words as W


@pytest.mark.parametrize(("kind", "pattern"), [(W.ALNUM, ALNUM), (W.SPACED, SPACED)])
def test_words_equal_the_pattern(kind, pattern):
    rng = random.Random(1)
    texts = [None, "", "A", "end", "start ", "é\tñ12 b", *("".join(rng.choice("aB1é \n.|\x0b\x7f{漢") for _ in range(rng.randrange(80))) for _ in range(300))]
    known: dict[bytes, int] = {}
    for i, j, data, w in W.runs(pa.array(texts), kind):
        for k in range(i, j):
            a, b = w.first[k - i], w.first[k - i + 1]
            got = [W._LOWER[data[s:e]].tobytes() for s, e in zip(w.start[a:b], w.end[a:b])]
            assert got == [x.encode() for x in words(texts[k], pattern)]
            for word, h in zip(got, w.hash[a:b].tolist()):
                assert known.setdefault(word, h) == h
    assert len(set(known.values())) == len(known)


def test_a_slice_never_splits_a_text():
    texts = pa.array(["abc def", "x" * 100, None, "y z"] * 5)
    data, offsets = W.utf8(texts)
    parts = list(W.slices(offsets, 50))
    assert parts[0][0] == 0 and parts[-1][1] == len(texts)
    assert all(a[1] == b[0] for a, b in zip(parts, parts[1:]))


def test_grams_stay_in_their_text():
    for _, _, _, w in W.runs(pa.array(["a b c", "d", "", "e f"]), W.ALNUM):
        assert W.gram_starts(w.first, 2).tolist() == [0, 1, 4]
