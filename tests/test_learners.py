import numpy as np
import pytest

from framewright.operators import learners as L
from framewright.operators import segmentation
from framewright.operators import signal_kernels as S


def two_groups(n=60, seed=0):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(-2, 0.5, (n, 2)), rng.normal(2, 0.5, (n, 2))])
    return x, np.repeat([-1, 1], n)


def test_codebook_and_partition():
    x, _ = two_groups()
    for means in (L.codebook(x, 2), L.variance_partition(x, 2)):
        assert sorted(np.round(means[:, 0]).astype(int)) == [-2, 2]
    assert len(L.variance_partition(np.zeros((5, 2)), 3)) <= 3


def test_kernel_machine():
    x, y = two_groups()
    ring = np.where((x**2).sum(1) > np.median((x**2).sum(1)), 1, -1)
    assert (np.sign(L.KernelMachine(1.0, 0.5).fit(x, y).decide(x)) == y).all()
    assert (np.sign(L.KernelMachine(100.0, 1.0).fit(x, ring).decide(x)) == ring).mean() > 0.85
    assert L.cross_validated(x[::6], y[::6], [1.0], [0.01, 0.5]) in {(1.0, 0.01), (1.0, 0.5)}


def test_markov_likelihood_grows():
    rng = np.random.default_rng(1)
    state = [0 if t // 10 % 2 else 1 for t in range(80)]
    x = np.array([[rng.normal(3.0 * s, 0.4)] for s in state])
    m = L.HiddenMarkov(2)
    history = m.fit([x, x[::-1]])
    assert all(b >= a - 1e-6 for a, b in zip(history, history[1:]))
    assert m.score(x) > m.score(rng.normal(1.5, 3, (80, 1)))


def test_discriminant_direction():
    x, y = two_groups()
    d = L.discriminants(x, y, 1)[:, 0]
    assert abs(d[0]) > 0.5 and abs(d[1]) > 0.5


def test_growing_gaussians_merge_exactly():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (200, 2))
    g = L.GrowingGaussians(near=10.0)
    g.add(x[:120])
    g.add(x[120:])
    n, mean, cov = g.parts[0]
    assert n == 200 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x, rowvar=False))
    g = L.GrowingGaussians(near=0.01)
    g.add(x)
    g.add(10 * x)
    assert len(g.parts) == 2


def test_maximum_model_integrates_to_one():
    t = np.linspace(-12, 12, 4001)[:, None]
    speech, noise = ([0.5, 0.5], [[0.0], [2.0]], [[1.0], [0.5]]), ([1.0], [[1.0]], [[1.0]])
    assert abs(np.exp(L.max_log_likelihood(t, speech, noise)).sum() * (24 / 4000) - 1) < 1e-3


def test_entropy_split():
    v = np.concatenate([np.arange(50.0), np.arange(100.0, 150.0)])
    y = np.repeat(["a", "b"], 50)
    assert L.entropy_split(v, y) == [74.5]
    assert L.entropy_split(v, np.array(["a"] * 100)) == []


def test_ratios():
    rng = np.random.default_rng(3)
    a, b = rng.normal(0, 1, (100, 2)), rng.normal(4, 1, (100, 2))
    assert L.change_rate(a, b) > 0.19547 > L.change_rate(a[:50], a[50:])


@pytest.mark.parametrize("taps", sorted(S.WAVELETS))
def test_wavelet_filters_are_orthonormal(taps):
    h = np.array(S.WAVELETS[taps])
    assert np.isclose((h**2).sum(), 1) and np.isclose(h.sum(), np.sqrt(2))
    high, low = S.wavelet(np.ones(16), 2, 1) if taps == 2 else (np.zeros(8), None)
    assert np.allclose(high, 0)


def test_signals():
    tone = S.wave("tone", 800, 8000, 100)
    assert np.allclose(S.resampled(tone, 8000, 16000)[::2], tone)
    assert len(S.resampled(tone, 8000, 4000)) == 400
    frames = np.lib.stride_tricks.sliding_window_view(tone, 64)[::32]
    assert np.allclose(S.overlap_add(frames, 32), tone[: 32 * (len(frames) - 1) + 64])
    taps = S.band_pass(101, 0.2, 0.4)
    power = lambda hz: (S.filtered(S.wave("tone", 800, 8000, hz), taps) ** 2)[200:600].mean()
    assert power(1200) > 100 * power(100) and power(1200) > 100 * power(3000)
    with pytest.raises(ValueError):
        S.band_pass(11, 0.5, 0.4)
    quiet = np.zeros((10, 8))
    quiet[4:7] = 1
    assert S.end_points(quiet) == (4, 6)
    assert S.end_points(np.zeros((0, 8))) == (0, -1)
    mix = tone + S.wave("tone", 800, 8000, 1000)
    modes = S.intrinsic_modes(mix)
    assert np.allclose(sum(modes), mix)
    image = S.dot_pattern(tone[:100], 16)
    assert image.sum() == 99 * 12 and S.bitmap(image)[:2] == b"BM" and len(S.bitmap(image)) == 54 + 16 * 48
    assert S.noise_frames(np.tile(tone[:80], (4, 1))).tolist() == [0.0] * 4


def test_merge_tree(spark):
    rows = sorted(tuple(r) for r in segmentation.merge_tree(spark, [(0, 1, 0.1), (0, 2, 0.5)], [0, 1, 2]).collect())
    assert rows == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2)]
