"""The sums of op2's fit against plain loops over decisions; its spelling against plain contexts is in test_operators."""

import numpy as np

from engram.llm import context_mixing as cm
from engram.llm.common import LOWER, pieces, strings


def decisions(n=400, seed=5):
    rng = np.random.default_rng(seed)
    gate = rng.integers(0, 5, n).astype(np.intp)
    inputs = [rng.normal(0, 2, n).astype(np.float32) for _ in cm.TABLE_BITS]
    return gate, inputs, rng.random(n) < 0.4, rng.integers(1, 9, n)


def test_slopes_match_a_loop():
    mixer, (gate, inputs, bit, times) = cm.Mixer.fresh(), decisions()
    want = np.zeros((cm.GATES, len(inputs) + 1, len(inputs) + 2))
    for i, g in enumerate(gate):
        x = np.array([*(v[i] for v in inputs), 1.0])
        p = 1 / (1 + np.exp(-np.clip(mixer.weights[g] @ x, -30, 30)))
        want[g, :, 0] += (bit[i] - p) * times[i] * x
        want[g, :, 1:] += p * (1 - p) * times[i] * np.outer(x, x)
    assert np.allclose(mixer.slopes(gate, inputs, bit, times), want, rtol=1e-3, atol=1e-2)


def test_cells_match_a_loop():
    mixer, (gate, inputs, bit, times) = cm.Mixer.fresh(), decisions()
    want = np.zeros((2, cm.GATES * cm.MAP_STEPS))
    for i, g in enumerate(gate):
        s = np.clip(2 * (mixer.weights[g] @ [*(v[i] for v in inputs), 1.0]) + cm.MAP_STEPS // 2, 0, cm.MAP_STEPS - 1.001)
        for cell, share in ((int(s), 1 - s % 1), (int(s) + 1, s % 1)):
            want[:, g * cm.MAP_STEPS + cell] += np.array([1, bit[i]]) * share * times[i]
    assert np.allclose(mixer.cells(gate, inputs, bit, times), want, rtol=1e-3, atol=1e-2)


def test_anchors_are_found_without_grouping():
    """A pass that only needs the anchors does not number the distinct words first."""
    (p,) = pieces(strings(["a b a c", "", "b d b"]))
    w, h, _, back = cm.distinct_words(p, LOWER[p.data])
    anchors = cm.Anchors(np.sort(w.hashes()[:2]), np.array([1, 2]))
    got, want = anchors.found(w.hashes()), anchors.found(h, back)
    assert [x.tolist() for x in got] == [x.tolist() for x in want]
    assert got[0].tolist() == [0, 1, 2, 4, 6]
