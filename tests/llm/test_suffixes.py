import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from diamondlake.llm.suffixes import permuted_prefixes, suffix_array


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_order_and_prefixes(symbols):
    for dtype in (np.uint8, np.int64):
        text = np.array(symbols, dtype)
        array = suffix_array(text)
        assert array.tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])
        prefix = permuted_prefixes(text, array, 9)
        for a, b in zip(array[:-1].tolist(), array[1:].tolist()):
            n = 0
            while n < 9 and max(a, b) + n < len(symbols) and symbols[a + n] == symbols[b + n]:
                n += 1
            assert prefix[b] == n


def test_many_symbols_and_depth():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 90_000, 3000)
    assert suffix_array(text).tolist() == sorted(range(3000), key=lambda i: text[i:].tolist())
    text = np.tile(rng.integers(0, 5, 300), 9)
    array = suffix_array(text, 40).tolist()
    cut = [text[i:i + 40].tolist() for i in array]
    assert cut == sorted(cut)
