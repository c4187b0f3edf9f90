"""Samples of poses are solved together, and refinement ends where nothing is left to gain."""

import numpy as np

from prismlake.operators import resection as S

K = (800.0, 800.0, 320.0, 240.0)


def exact(n, seed):
    rng = np.random.default_rng(seed)
    p = rng.normal(size=(n, 3))
    q = p + [0.1, -0.2, 8.0]
    return p, np.column_stack([800 * q[:, 0] / q[:, 2] + 320, 800 * q[:, 1] / q[:, 2] + 240])


def test_samples_together_give_what_each_gives():
    p, uv = exact(30, 1)
    rays = S.bearings(uv, K)
    sample = np.arange(30).reshape(10, 3)
    sample[4] = 7  # one place thrice: no pose
    of, r, t = S.from_threes(p[sample], rays[sample])
    assert set(of) == set(range(10)) - {4}
    for i in range(10):
        one = S.from_three(p[sample[i]], rays[sample[i]])
        assert len(one) == (of == i).sum() and all(np.allclose(a, b) and np.allclose(c, d) for (a, c), b, d in zip(one, r[of == i], t[of == i], strict=True))
        assert i == 4 or min(np.abs(t[of == i] - [0.1, -0.2, 8.0]).max(axis=1)) < 1e-6


def test_exact_pixels_take_few_steps_and_the_same_pose(monkeypatch):
    p, uv = exact(200, 2)
    calls, whole = [], S._equations
    monkeypatch.setattr(S, "_equations", lambda *a: calls.append(1) or whole(*a))
    r, t = S.refined(np.eye(3), np.array([0.12, -0.15, 8.1]), p, uv, K)
    assert np.abs(r - np.eye(3)).max() < 1e-9 and np.abs(t - [0.1, -0.2, 8.0]).max() < 1e-9
    assert len(calls) <= 10
