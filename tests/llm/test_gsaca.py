import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm.gsaca import suffix_arrays


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=24), min_size=1, max_size=5))
def test_against_sorting(texts):
    texts = [[*t, 0] for t in texts]
    found = suffix_arrays(np.array(sum(texts, [])), np.array([len(t) for t in texts]))
    expected, base = [], 0
    for t in texts:
        expected += [base + i for i in sorted(range(len(t)), key=lambda i, t=t: t[i:])]
        base += len(t)
    assert found.tolist() == expected


def test_longer_texts():
    rng = np.random.default_rng(2)
    for alphabet in (1, 2, 26, 250):
        texts = [[*rng.integers(1, alphabet + 1, rng.integers(1, 400)).tolist(), 0] for _ in range(30)]
        texts.append([*([1, 2] * 150), 0])
        found = suffix_arrays(np.array(sum(texts, [])), np.array([len(t) for t in texts]))
        base = 0
        for t in texts:
            assert (found[base : base + len(t)] - base).tolist() == sorted(range(len(t)), key=lambda i, t=t: t[i:])
            base += len(t)
