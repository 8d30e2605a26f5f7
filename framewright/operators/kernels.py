"""Numeric kernels in numpy for what is inherently sequential or spectral. They take small
arrays (a frame, a segment, a model); ``operators.spectral`` applies them in Arrow batches."""

from __future__ import annotations

import numpy as np


def mel_bank(filters: int, bins: int, rate: float) -> np.ndarray:
    """Triangular filters, equally spaced in mel, over the bins of a magnitude spectrum."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), filters + 2) / 2595) - 1)
    hz = np.linspace(0, rate / 2, bins)
    up = (hz - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - hz) / (edges[2:] - edges[1:-1])[:, None]
    return np.clip(np.minimum(up, down), 0, None)


def spectrum(frames: np.ndarray, window: np.ndarray | None = None) -> np.ndarray:
    """Magnitudes of the positive frequencies of each frame (a row), padded to a power of 2."""
    n = 1 << max(0, int(frames.shape[1] - 1).bit_length())
    return np.abs(np.fft.rfft(frames if window is None else frames * window, n))


def mfcc(frames: np.ndarray, rate: float, filters: int = 40, coefficients: int = 20, alpha: float = 0.97) -> np.ndarray:
    """Mel-frequency cepstra: pre-emphasis, Hamming window, mel bank, log10, cosines."""
    x = np.concatenate([frames[:, :1], frames[:, 1:] - alpha * frames[:, :-1]], axis=1)
    mag = spectrum(x, np.hamming(x.shape[1]))
    energy = np.log10(np.maximum(mag @ mel_bank(filters, mag.shape[1], rate).T, 1e-10))
    c = np.arange(coefficients)[:, None]
    return energy @ np.cos(np.pi * c * (np.arange(filters) + 0.5) / filters).T


def lpc(frame: np.ndarray, order: int) -> tuple[np.ndarray, float]:
    """Linear prediction by autocorrelation and the Levinson-Durbin recursion: coefficients
    with a leading 1, and the gain."""
    n = len(frame)
    r = np.array([frame[: n - k] @ frame[k:] for k in range(order + 1)], dtype=float)
    a, e = np.zeros(order + 1), r[0]
    a[0] = 1.0
    for i in range(1, order + 1):
        if e <= 0:
            break
        k = -(a[:i] @ r[i:0:-1]) / e
        a[1 : i + 1] += k * a[i - 1 :: -1][:i]
        e *= 1 - k * k
    return a, float(np.sqrt(max(e, 0.0)))


def lpc_cepstrum(a: np.ndarray, gain: float, n: int) -> np.ndarray:
    c = np.zeros(n)
    c[0] = np.log(max(gain, 1e-10))
    for m in range(1, n):
        c[m] = -(a[m] if m < len(a) else 0.0) - sum(k / m * c[k] * a[m - k] for k in range(1, m) if m - k < len(a))
    return c


def line_spectrum(a: np.ndarray) -> np.ndarray:
    """Line spectral frequencies: the angles of the roots of the sum and difference polynomials."""
    p, q = np.append(a, 0) + np.append(0, a[::-1]), np.append(a, 0) - np.append(0, a[::-1])
    angles = np.concatenate([np.angle(np.roots(p)), np.angle(np.roots(q))])
    return np.sort(angles[(angles > 1e-6) & (angles < np.pi - 1e-6)])


def pitch(frame: np.ndarray, rate: float, low: float = 60.0, high: float = 400.0, least: float = 0.5) -> float:
    """The frequency of the highest normalised autocorrelation, 0 if that is under ``least``."""
    best, found = least, 0.0
    for lag in range(max(1, int(rate / high)), min(len(frame) - 1, int(rate / low)) + 1):
        a, b = frame[:-lag], frame[lag:]
        norm = np.sqrt((a @ a) * (b @ b))
        if norm > 0 and a @ b / norm > best + 1e-12:
            best, found = a @ b / norm, rate / lag
    return found


def dtw(a: np.ndarray, b: np.ndarray, band: float = 0.3) -> float:
    """Dynamic time warping with slopes of a half to two inside a band, over the length of
    the first sequence; infinite if no path fits."""
    n, m = len(a), len(b)
    d = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(-1))
    width = max(int(band * max(n, m)), abs(n - m)) + 1
    cost = np.full((n + 2, m + 2), np.inf)
    cost[1, 1] = 0.0
    for i in range(n):
        for j in range(max(0, i * m // n - width), min(m, i * m // n + width + 1)):
            steps = [cost[i + 1, j + 1] + d[i, j]]
            if j:
                steps.append(cost[i + 1, j] + 0.5 * (d[i, j - 1] + d[i, j]))
            if i:
                steps.append(cost[i, j + 1] + 0.5 * (d[i - 1, j] + d[i, j]))
            cost[i + 2, j + 2] = min(steps)
    return float(cost[n + 1, m + 1] / n)


def viterbi(log_start: np.ndarray, log_move: np.ndarray, log_emit: np.ndarray) -> tuple[list[int], float]:
    """The best state path of a hidden Markov model and its log probability."""
    score, back = log_start + log_emit[0], []
    for row in log_emit[1:]:
        every = score[:, None] + log_move
        back.append(every.argmax(0))
        score = every.max(0) + row
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1], float(score.max())


def forward(log_start: np.ndarray, log_move: np.ndarray, log_emit: np.ndarray) -> float:
    """Log probability of an observed sequence."""
    score = log_start + log_emit[0]
    for row in log_emit[1:]:
        score = np.logaddexp.reduce(score[:, None] + log_move, axis=0) + row
    return float(np.logaddexp.reduce(score))


def emd(weights_a: np.ndarray, weights_b: np.ndarray, ground: np.ndarray) -> float:
    """Earth mover's distance: successive shortest paths on the transport graph."""
    supply, demand = weights_a.astype(float).copy(), weights_b.astype(float).copy()
    flow = np.zeros_like(ground, dtype=float)
    n, m = ground.shape
    while supply.sum() > 1e-12 and demand.sum() > 1e-12:
        da, db = np.where(supply > 1e-12, 0.0, np.inf), np.full(m, np.inf)
        pa, pb = np.full(n, -1), np.full(m, -1)
        for _ in range(n + m):
            to_b = da[:, None] + ground
            k = to_b.argmin(0)
            better = to_b.min(0) < db - 1e-12
            db[better], pb[better] = to_b.min(0)[better], k[better]
            to_a = np.where(flow > 1e-12, db[None, :] - ground, np.inf)
            k = to_a.argmin(1)
            back = to_a.min(1) < da - 1e-12
            da[back], pa[back] = to_a.min(1)[back], k[back]
            if not better.any() and not back.any():
                break
        j = int(np.where(demand > 1e-12, db, np.inf).argmin())
        path, i = [], int(pb[j])
        end = j
        while True:
            path.append((i, j, 1))
            if pa[i] < 0:
                break
            j = int(pa[i])
            path.append((i, j, -1))
            i = int(pb[j])
        amount = min([supply[i], demand[end], *(flow[x, y] for x, y, s in path if s < 0)])
        for x, y, s in path:
            flow[x, y] += s * amount
        supply[i] -= amount
        demand[end] -= amount
    moved = flow.sum()
    return float((flow * ground).sum() / moved) if moved else 0.0


def symmetric_kl(mean_a, cov_a, mean_b, cov_b) -> float:
    """Symmetric Kullback-Leibler divergence of two Gaussians."""
    ia, ib = np.linalg.pinv(cov_a), np.linalg.pinv(cov_b)
    d = np.asarray(mean_a) - np.asarray(mean_b)
    return float(0.5 * np.trace((cov_a - cov_b) @ (ib - ia)) + 0.5 * d @ (ia + ib) @ d)


def divergence_shape(cov_a: np.ndarray, cov_b: np.ndarray) -> float:
    """The part of that divergence which compares covariances only."""
    return float(0.5 * np.trace((cov_a - cov_b) @ (np.linalg.pinv(cov_b) - np.linalg.pinv(cov_a))))


def delta_bic(a: np.ndarray, b: np.ndarray, penalty: float = 1.0) -> float:
    """Bayesian information criterion of modelling two sets of rows by one Gaussian instead
    of two: positive if they differ."""
    both, d = np.vstack([a, b]), a.shape[1]
    half = lambda x: 0.5 * len(x) * np.linalg.slogdet(np.cov(x, rowvar=False).reshape(d, d) + 1e-9 * np.eye(d))[1]
    return float(half(both) - half(a) - half(b) - penalty * 0.5 * (d + d * (d + 1) / 2) * np.log(len(both)))


def agglomerate(distance: np.ndarray, linkage: str = "average", stop: float = np.inf, clusters: int = 1) -> list[tuple[int, int, float]]:
    """Merges of the closest pair, the first of ties, until a distance exceeds ``stop`` or
    few enough clusters are left: (kept, merged, distance) by the members' first index."""
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, merges, n = np.ones(len(d)), [], len(d)
    live = np.ones(n, dtype=bool)
    later = np.arange(n)[None, :] > np.arange(n)[:, None]
    # each row's first closest later one; a merge leaves those of most rows as they are
    best = np.argmin(np.where(later, d, np.inf), axis=1) if n else np.zeros(0, dtype=np.int64)
    least = np.where(later[np.arange(n), best], d[np.arange(n), best], np.inf)
    while live.sum() > clusters:
        i = int(np.argmin(least))
        j = int(best[i])
        if not live[i] or i >= j or not live[j] or not d[i, j] <= stop:
            break
        merges.append((i, j, float(d[i, j])))
        if linkage == "single":
            new = np.minimum(d[i], d[j])
        elif linkage == "complete":
            new = np.maximum(d[i], d[j])
        else:
            new = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        new[~live] = np.inf
        d[i], d[:, i] = new, new
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        live[j], least[j] = False, np.inf
        closer = live & later[:, i] & ((d[:, i] < least) | (d[:, i] == least) & (i < best))
        stale = np.flatnonzero(live & ~closer & ((best == j) | (best == i)))
        best[closer], least[closer] = i, d[closer, i]
        for r in {i, *stale.tolist()}:
            best[r] = r + 1 + int(np.argmin(d[r, r + 1 :])) if r + 1 < n else r
            least[r] = d[r, best[r]]
    return merges


class Clusters:
    """Clusters of weighted points, ``member`` being the first point of each point's
    cluster; finds a cluster's nearest one by the rule single, complete or average.

    Average and largest distance are no less than that of the means, the least one is no
    less than that without both radii; only clusters whose bound is not above the best
    distance so far are compared by their members."""

    def __init__(self, values: np.ndarray, weight: np.ndarray, member: np.ndarray, rule: str):
        self.values, self.weight, self.member, self.rule = values, weight, member, rule
        order = np.argsort(member, kind="stable")
        self.names, start = np.unique(member[order], return_index=True)
        self._end = np.append(start, len(order))
        self._v, self._w = values[order], weight[order]
        self._total = np.add.reduceat(self._w, start)
        self._mean = np.add.reduceat(self._v * self._w[:, None], start) / self._total[:, None]
        self._single = np.diff(self._end) == 1
        self._mean[self._single] = self._v[start[self._single]]
        off = np.sqrt(((self._v - np.repeat(self._mean, np.diff(self._end), axis=0)) ** 2).sum(1))
        self._radius = np.maximum.reduceat(off, start) * (1 + 1e-9)
        self._columns = np.ascontiguousarray(self._mean.T)

    def distance(self, a: int, b: int, most: int = 1 << 18) -> float:
        """Of two clusters, by their places in ``names``; the same for ``b, a``."""
        a, b = min(a, b), max(a, b)
        (x, u), (y, w) = ((self._v[s:e], self._w[s:e]) for s, e in ((self._end[k], self._end[k + 1]) for k in (a, b)))
        got, step = [], max(1, most // len(y))
        for k in range(0, len(x), step):
            d = np.zeros((len(x[k : k + step]), len(y)))
            for p, q in zip(x[k : k + step].T, y.T):
                gap = np.subtract.outer(p, q)
                gap *= gap
                d += gap
            np.sqrt(d, out=d)
            got.append(d.min() if self.rule == "single" else d.max() if self.rule == "complete" else float(u[k : k + step] @ (d @ w)))
        if self.rule == "single":
            return float(min(got))
        return float(max(got)) if self.rule == "complete" else float(sum(got) / (self._total[a] * self._total[b]))

    def nearest(self, name: int) -> tuple[int, float]:
        """The first of a cluster's nearest ones by name, and its distance."""
        own = int(np.searchsorted(self.names, name))
        bound = np.zeros(len(self.names))
        for col in self._columns:
            gap = col - col[own]
            gap *= gap
            bound += gap
        np.sqrt(bound, out=bound)
        if self.rule == "single":
            bound -= self._radius + self._radius[own]
        best, at = np.inf, -1
        if self._single[own]:  # between single points the bound is the distance
            exact = np.where(self._single, bound, np.inf)
            exact[own] = np.inf
            at = int(np.argmin(exact))
            best = float(exact[at])
        bound[own] = np.inf
        if best == np.inf:
            at = int(np.argmin(bound))
            best = self.distance(own, at)
        close = np.flatnonzero(bound <= best * (1 + 1e-9))
        for k in close[np.argsort(bound[close], kind="stable")].tolist():
            if bound[k] > best * (1 + 1e-9):
                break
            if self._single[own] and self._single[k]:
                continue
            d = self.distance(own, k)
            if d < best or d == best and k < at:
                best, at = d, k
        return int(self.names[at]), best
