from __future__ import annotations

import numpy as np
import pytest

from recordlake.llm import induced


@pytest.mark.parametrize("bounds", [{}, {"memory": 50, "base": 8}, {"memory": 10_000, "base": 8}])
def test_order_equals_plain_sorting(bounds):
    r = np.random.default_rng(1)
    for n in (1, 2, 5, 40, 400):
        for symbols in (1, 2, 3, 50):
            text = np.append(r.integers(1, symbols + 1, n), 0)
            want = sorted(range(n + 1), key=lambda i: text[i:].tolist(), reverse=True)
            assert np.concatenate(list(induced.suffixes(text, **bounds))).tolist() == want


def test_window_groups():
    r = np.random.default_rng(2)
    data = r.integers(97, 99, 3000).astype(np.uint8)
    valid = np.zeros(3001, bool)
    valid[: 3000 - 11] = True
    got = set()
    for places, starts in induced.window_groups(data, np.append(data.astype(np.int64), 0), valid, 12, memory=500, base=100):
        got |= {frozenset(g.tolist()) for g in np.split(places, starts[1:])}
    want: dict[bytes, set] = {}
    for i in range(3000 - 11):
        want.setdefault(data[i : i + 12].tobytes(), set()).add(i)
    assert got == {frozenset(v) for v in want.values()}
