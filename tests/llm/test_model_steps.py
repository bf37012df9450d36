"""Steps of the language model on whole arrays give what their plain forms give."""

import numpy as np

from burstlake.llm import lm


def test_distinct_words_as_unique_has_them():
    h = np.random.default_rng(3).integers(0, 2**64, 50, dtype=np.uint64)[np.random.default_rng(4).integers(0, 50, 4000)]
    for some in (h, h[:1]):
        for a, b in zip(lm._distinct(some), np.unique(some, return_inverse=True, return_counts=True)):
            assert (a == b).all()


def test_gradient_steps_add_branch_by_branch(monkeypatch):
    """Pairs of branches added as one number: half the indices, the same bits as one by one."""
    rng = np.random.default_rng(5)
    words, counts = rng.integers(0, 2**63, 300, dtype=np.uint64), rng.integers(1, 90, 300)
    tree = lm.grow_tree(words, counts, np.ones(lm.SHARED))
    h = words[rng.integers(0, 300, 900)]
    y, f, bits = tree.symbols(h), lm.history(h, np.arange(900)), 9
    w = rng.normal(size=(1 << bits, lm.FAN)).astype(np.float32)
    want, used, square = w.copy(), np.zeros(len(w), np.float32), np.full(len(w), 1e-6, np.float32)
    for has, node, branch, rows in lm._steps(tree, bits, y, f):
        g = lm._powers(want, rows, tree.shares[node])
        g /= (g @ np.ones(lm.FAN, np.float32))[:, None]
        g[np.arange(len(has)), branch] -= 1
        n = np.bincount(rows.reshape(-1), minlength=len(used)).astype(np.float32)
        for r in rows:
            np.add.at(square, r, np.einsum("ij,ij->i", g, g) / lm.FAN)
        for r in rows:
            step = g * (np.float32(-0.1) / np.sqrt(square[r] * n[r]))[:, None]
            for b in range(lm.FAN):
                np.add.at(want[:, b], r, step[:, b])
        used += n
    sizes, add = [], np.add

    class Add:
        at = staticmethod(lambda a, i, v: sizes.append(len(i)) or add.at(a, i, v))
        reduceat = add.reduceat

    monkeypatch.setattr(lm.np, "add", Add)
    lm.descend(tree, w, np.zeros(len(w), np.float32), np.full(len(w), 1e-6, np.float32), bits, y, f, 0.1)
    assert (w == want).all() and max(sizes) == 900 * lm.FAN // 2
