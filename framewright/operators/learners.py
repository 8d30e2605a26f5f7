"""Learners in numpy for bounded training sets: vector quantisation, hidden Markov models,
support vectors, discriminant analysis, incremental and maximum mixtures."""

from __future__ import annotations

import numpy as np

from framewright.operators.kernels import divergence_shape, forward


def codebook(x: np.ndarray, size: int, sweeps: int = 20) -> np.ndarray:
    """Linde-Buzo-Gray: the mean is split and refined until there are ``size`` vectors."""
    book = x.mean(0, keepdims=True)
    while len(book) < size:
        book = np.concatenate([book * 1.01 + 1e-6, book * 0.99 - 1e-6])[:size]
        for _ in range(sweeps):
            near = ((x[:, None] - book[None]) ** 2).sum(-1).argmin(1)
            new = np.array([x[near == k].mean(0) if (near == k).any() else book[k] for k in range(len(book))])
            if np.allclose(new, book):
                break
            book = new
    return book


def variance_partition(x: np.ndarray, k: int) -> np.ndarray:
    """Initial means: the cluster with the largest squared error is split at the mean of
    its dimension of largest variance, until there are k."""
    parts = [x]
    while len(parts) < k:
        worst = max(range(len(parts)), key=lambda i: ((parts[i] - parts[i].mean(0)) ** 2).sum())
        p = parts.pop(worst)
        d = int(p.var(0).argmax())
        low = p[:, d] <= p[:, d].mean()
        if low.all():
            parts.append(p)
            break
        parts += [p[low], p[~low]]
    return np.array([p.mean(0) for p in parts])


class HiddenMarkov:
    """Hidden Markov model with a diagonal Gaussian in each state, trained by Baum-Welch."""

    def __init__(self, states: int, seed: int = 0):
        self.states, self.rng = states, np.random.default_rng(seed)

    def emission(self, x: np.ndarray) -> np.ndarray:
        d = (x[:, None] - self.mean) ** 2 / self.var + np.log(2 * np.pi * self.var)
        return -0.5 * d.sum(-1)

    def fit(self, sequences: list[np.ndarray], rounds: int = 20, floor: float = 1e-3) -> list[float]:
        every, s = np.concatenate(sequences), self.states
        self.mean = variance_partition(every, s)
        if len(self.mean) < s:
            self.mean = every[self.rng.choice(len(every), s)]
        self.var = np.tile(np.maximum(every.var(0), floor), (s, 1))
        self.start, self.move = np.log(np.full(s, 1 / s)), np.log(np.full((s, s), 0.5 / s) + 0.5 * np.eye(s))
        history = []
        for _ in range(rounds):
            begin, moves, n, total, square, ll = np.zeros(s), np.zeros((s, s)), np.zeros(s), 0.0, 0.0, 0.0
            for x in sequences:
                b = self.emission(x)
                f, r = np.zeros_like(b), np.zeros_like(b)
                f[0] = self.start + b[0]
                for t in range(1, len(x)):
                    f[t] = np.logaddexp.reduce(f[t - 1][:, None] + self.move, axis=0) + b[t]
                for t in range(len(x) - 2, -1, -1):
                    r[t] = np.logaddexp.reduce(self.move + (b[t + 1] + r[t + 1])[None], axis=1)
                p = np.logaddexp.reduce(f[-1])
                g = np.exp(f + r - p)
                for t in range(len(x) - 1):
                    moves += np.exp(f[t][:, None] + self.move + (b[t + 1] + r[t + 1])[None] - p)
                begin, n, ll = begin + g[0], n + g.sum(0), ll + p
                total, square = total + g.T @ x, square + g.T @ (x * x)
            history.append(float(ll))
            self.start = np.log(np.maximum(begin / begin.sum(), 1e-12))
            self.move = np.log(np.maximum(moves / np.maximum(moves.sum(1, keepdims=True), 1e-12), 1e-12))
            self.mean = total / np.maximum(n, 1e-12)[:, None]
            self.var = np.maximum(square / np.maximum(n, 1e-12)[:, None] - self.mean**2, floor)
            if len(history) > 1 and history[-1] - history[-2] < 1e-4:
                break
        return history

    def score(self, x: np.ndarray) -> float:
        return forward(self.start, self.move, self.emission(x)) / len(x)


class KernelMachine:
    """Two-class support vector machine with a Gaussian kernel, by dual coordinate ascent;
    with one class, distances to the data's centre in the kernel's space."""

    def __init__(self, cost: float = 1.0, gamma: float = 1.0, sweeps: int = 50):
        self.cost, self.gamma, self.sweeps = cost, gamma, sweeps

    def _kernel(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.exp(-self.gamma * ((a[:, None] - b[None]) ** 2).sum(-1)) + 1.0  # the bias is in the kernel

    def fit(self, x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None) -> "KernelMachine":
        k = self._kernel(x, x) * np.outer(y, y)
        top = self.cost * (np.ones(len(x)) if weights is None else weights)
        a = np.zeros(len(x))
        for _ in range(self.sweeps):
            before = a.copy()
            for i in range(len(x)):
                a[i] = min(max(a[i] + (1 - k[i] @ a) / k[i, i], 0.0), top[i])
            if np.abs(a - before).max() < 1e-5:
                break
        keep = a > 1e-9
        self.x, self.a = x[keep], (a * y)[keep]
        return self

    def decide(self, x: np.ndarray) -> np.ndarray:
        return self._kernel(x, self.x) @ self.a


def cross_validated(x: np.ndarray, y: np.ndarray, costs, gammas, folds: int = 4) -> tuple[float, float]:
    """The cost and gamma of the least error over interleaved folds, the first of ties."""
    part = np.arange(len(x)) % folds

    def error(c: float, g: float) -> float:
        return sum(
            (np.sign(KernelMachine(c, g).fit(x[part != f], y[part != f]).decide(x[part == f])) != y[part == f]).sum() for f in range(folds)
        )

    return min(((c, g) for c in costs for g in gammas), key=lambda p: error(*p))


def discriminants(x: np.ndarray, labels: np.ndarray, dims: int) -> np.ndarray:
    """Linear discriminant directions: eigenvectors of within^-1 * between scatter."""
    mean = x.mean(0)
    within, between = np.zeros((x.shape[1],) * 2), np.zeros((x.shape[1],) * 2)
    for c in np.unique(labels):
        p = x[labels == c]
        d = p - p.mean(0)
        within += d.T @ d
        between += len(p) * np.outer(p.mean(0) - mean, p.mean(0) - mean)
    value, vector = np.linalg.eig(np.linalg.pinv(within) @ between)
    return np.real(vector[:, np.argsort(-np.real(value))[:dims]])


class GrowingGaussians:
    """Incremental mixture of full Gaussians: a block of rows joins the component whose
    covariance shape is nearest, if near enough, or opens a new one."""

    def __init__(self, near: float = 0.05):
        self.near, self.parts = near, []  # n, mean, covariance

    def add(self, x: np.ndarray) -> None:
        n, mean, cov = len(x), x.mean(0), np.cov(x, rowvar=False).reshape(x.shape[1], x.shape[1])
        off = [divergence_shape(cov, c) for _, _, c in self.parts]
        if off and min(off) <= self.near:
            k = int(np.argmin(off))
            m, old, c = self.parts[k]
            both = m + n
            shift = mean - old
            merged = ((m - 1) * c + (n - 1) * cov + m * n / both * np.outer(shift, shift)) / (both - 1)
            self.parts[k] = (both, old + n / both * shift, merged)
        else:
            self.parts.append((n, mean, cov))

    def score(self, cov: np.ndarray) -> float:
        total = sum(n for n, _, _ in self.parts)
        return float(sum(n / total * divergence_shape(cov, c) for n, _, c in self.parts))


def max_log_likelihood(x: np.ndarray, speech, noise) -> np.ndarray:
    """Log density of rows that are the maximum of a speech and a noise mixture, both given
    as (weights, means, variances): pdf of one times distribution function of the other."""
    from math import erf

    cdf = np.vectorize(lambda z: 0.5 * (1 + erf(z / np.sqrt(2))))

    def parts(m):
        w, mean, var = (np.asarray(v, dtype=float) for v in m)
        z = (x[:, None] - mean) / np.sqrt(var)
        return w, np.exp(-0.5 * z * z) / np.sqrt(2 * np.pi * var), cdf(z)

    ws, ps, cs = parts(speech)
    wn, pn, cn = parts(noise)
    joint = (ps[:, :, None] * cn[:, None] + cs[:, :, None] * pn[:, None]).prod(-1)
    return np.log(np.maximum(np.einsum("i,j,tij->t", ws, wn, joint), 1e-300))


def model_order(rows: int, per_component: int, most: int) -> int:
    return max(1, min(most, rows // per_component))


def entropy_split(values: np.ndarray, labels: np.ndarray) -> list[float]:
    """Cut points of a feature by entropy, as far as minimum description length allows."""

    def entropy(y: np.ndarray) -> tuple[float, int]:
        _, n = np.unique(y, return_counts=True)
        p = n / n.sum()
        return float(-(p * np.log2(p)).sum()), len(n)

    order = np.argsort(values, kind="stable")
    v, y = values[order], labels[order]
    whole, kinds = entropy(y)
    best = None
    for i in np.flatnonzero(v[1:] > v[:-1]) + 1:
        (a, ka), (b, kb) = entropy(y[:i]), entropy(y[i:])
        rest = (i * a + (len(y) - i) * b) / len(y)
        if best is None or rest < best[0] - 1e-12:
            best = rest, i, np.log2(3.0**kinds - 2) - (kinds * whole - ka * a - kb * b)
    if best is None or whole - best[0] <= (np.log2(len(y) - 1) + best[2]) / len(y):
        return []
    cut, i = (v[best[1] - 1] + v[best[1]]) / 2, best[1]
    return [*entropy_split(v[:i], y[:i]), float(cut), *entropy_split(v[i:], y[i:])]


def normalised_score(score: float, own: float, cross_a: float, other: float, cross_b: float) -> float:
    """Distance normalisation: a score over the symmetrised divergence of client and world."""
    d = (own - cross_a) + (other - cross_b)
    return score / d if d else 0.0


def likelihood_ratio(a: np.ndarray, b: np.ndarray) -> float:
    """Generalised likelihood ratio of two sets of rows under one Gaussian against two."""
    d = a.shape[1]
    half = lambda x: 0.5 * len(x) * np.linalg.slogdet(np.cov(x, rowvar=False).reshape(d, d) + 1e-9 * np.eye(d))[1]
    return float(half(np.vstack([a, b])) - half(a) - half(b))


def change_rate(a: np.ndarray, b: np.ndarray) -> float:
    """Information change rate: the ratio above for each row."""
    return likelihood_ratio(a, b) / (len(a) + len(b))
