"""More signal kernels in numpy: filters, wavelets, resampling, generators, images."""

from __future__ import annotations

import numpy as np

# Low-pass coefficients of Daubechies wavelets, by their number of taps.
WAVELETS = {
    2: (0.7071067811865476, 0.7071067811865476),
    4: (0.48296291314469025, 0.836516303737469, 0.22414386804185735, -0.12940952255092145),
    6: (0.3326705529509569, 0.8068915093133388, 0.4598775021193313, -0.13501102001039084, -0.08544127388224149, 0.035226291882100656),
}


def wavelet(x: np.ndarray, taps: int = 4, levels: int = 1) -> list[np.ndarray]:
    """Details of each level, then the last approximation; zeros follow the signal."""
    low = np.array(WAVELETS[taps])
    high = low[::-1] * (-1.0) ** np.arange(taps)
    out = []
    for _ in range(levels):
        padded = np.append(x, np.zeros(taps))
        windows = np.lib.stride_tricks.sliding_window_view(padded, taps)[: len(x) : 2]
        out.append(windows @ high)
        x = windows @ low
    return [*out, x]


def band_pass(taps: int, low: float, high: float) -> np.ndarray:
    """A windowed-sinc filter for normalised frequencies between 0 and 1 (half the rate)."""
    if not 0 < low < high < 1:
        raise ValueError("0 < low < high < 1 must hold")
    t = np.arange(taps) - (taps - 1) / 2
    return (high * np.sinc(high * t) - low * np.sinc(low * t)) * np.hamming(taps)


def filtered(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    return np.convolve(x, taps, mode="same")


def resampled(x: np.ndarray, rate: float, new_rate: float) -> np.ndarray:
    """Linear interpolation at the new rate, after a low pass if that is lower."""
    if new_rate < rate:
        taps = 31
        t = np.arange(taps) - (taps - 1) / 2
        low = new_rate / rate * np.sinc(new_rate / rate * t) * np.hamming(taps)
        x = np.convolve(x, low / low.sum(), mode="same")
    n = int(len(x) * new_rate / rate)
    return np.interp(np.arange(n) * rate / new_rate, np.arange(len(x)), x)


def cepstrum(frames: np.ndarray) -> np.ndarray:
    """Inverse transform of the log power spectrum of each frame."""
    return np.fft.irfft(np.log(np.maximum(np.abs(np.fft.rfft(frames)) ** 2, 1e-12)))


def correlations(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Normalised correlation of a frame's begin with another's end, for each lag from 1."""
    n = len(a)
    out = np.zeros(n - 1)
    for lag in range(1, n):
        x, y = a[: n - lag], b[lag:]
        norm = np.sqrt(x @ x) * np.sqrt(y @ y)
        out[lag - 1] = x @ y / norm if norm > 0 else 0.0
    return out


def noise_frames(frames: np.ndarray, least: float = 0.3) -> np.ndarray:
    """1 for a frame whose correlation with its predecessor stays under ``least``; the
    first frame is like the second."""
    flag = np.array([float(correlations(a, b).max() < least) for a, b in zip(frames[:-1], frames[1:])])
    return np.append(flag[:1], flag) if len(flag) else np.zeros(len(frames))


def band_periodicity(frames: np.ndarray, edges=(1 / 8, 1 / 4, 1 / 2)) -> np.ndarray:
    """Per frame and sub-band the highest correlation with the frame before."""
    bounds = [1e-3, *edges, 0.999]
    out = np.zeros((len(frames), len(bounds) - 1))
    for k, (low, high) in enumerate(zip(bounds, bounds[1:])):
        band = np.array([filtered(f, band_pass(min(31, frames.shape[1] | 1), low, high)) for f in frames])
        for i in range(1, len(frames)):
            out[i, k] = correlations(band[i - 1], band[i]).max()
    if len(out) > 1:
        out[0] = out[1]
    return out


def residual(frame: np.ndarray, a: np.ndarray) -> np.ndarray:
    """What linear prediction leaves of a frame."""
    return np.convolve(frame, a)[: len(frame)]


def formants(a: np.ndarray, rate: float, most: int = 4) -> np.ndarray:
    """Frequencies of the prediction polynomial's poles, ascending, padded with zeros."""
    roots = np.roots(a)
    f = np.sort(np.angle(roots[np.imag(roots) > 1e-9]) * rate / (2 * np.pi))[:most]
    return np.pad(f, (0, most - len(f)))


def end_points(frames: np.ndarray, factor: float = 0.3) -> tuple[int, int]:
    """First and last frame with an energy over min + factor * (mean - min); (0, -1) if none."""
    e = (frames.astype(float) ** 2).sum(1)
    hit = np.flatnonzero(e > e.min() + factor * (e.mean() - e.min())) if len(e) else []
    return (int(hit[0]), int(hit[-1])) if len(hit) else (0, -1)


def wave(kind: str, n: int, rate: float, hz: float, seed: int = 0) -> np.ndarray:
    """A tone, square, saw or noise of n samples with amplitude 1."""
    phase = np.arange(n) * hz / rate
    if kind == "noise":
        return np.random.default_rng(seed).uniform(-1, 1, n)
    return {"tone": np.sin(2 * np.pi * phase), "square": np.where(phase % 1 < 0.5, 1.0, -1.0), "saw": 2 * (phase % 1) - 1}[kind]


def overlap_add(frames: np.ndarray, step: int) -> np.ndarray:
    """The signal of overlapping frames, each sample the mean of what covers it."""
    n = (len(frames) - 1) * step + frames.shape[1]
    total, cover = np.zeros(n), np.zeros(n)
    for k, f in enumerate(frames):
        total[k * step : k * step + len(f)] += f
        cover[k * step : k * step + len(f)] += 1
    return total / np.maximum(cover, 1)


def dot_pattern(frame: np.ndarray, size: int = 16, lag: int = 1, mirrors: int = 6) -> np.ndarray:
    """The symmetrised dot pattern of a frame as a size * size image of counts: radius by a
    sample, angle by the one ``lag`` later, mirrored around the centre."""
    span = frame.max() - frame.min()
    u = (frame - frame.min()) / span if span > 0 else np.zeros(len(frame))
    radius, swing = u[:-lag], u[lag:] * np.pi / mirrors
    image = np.zeros((size, size), dtype=int)
    for m in range(mirrors):
        for side in (1, -1):
            angle = 2 * np.pi * m / mirrors + side * swing
            x = np.clip(((1 + radius * np.cos(angle)) / 2 * size).astype(int), 0, size - 1)
            y = np.clip(((1 + radius * np.sin(angle)) / 2 * size).astype(int), 0, size - 1)
            np.add.at(image, (y, x), 1)
    return image


def bitmap(image: np.ndarray) -> bytes:
    """A grey-level image as a BMP file."""
    h, w = image.shape
    grey = (255 * image / max(1, image.max())).astype(np.uint8)
    rows = b"".join(bytes(np.repeat(r, 3)) + b"\0" * (-3 * w % 4) for r in grey[::-1])
    head = (54 + len(rows)).to_bytes(4, "little") + b"\0" * 4 + (54).to_bytes(4, "little")
    info = b"".join(v.to_bytes(n, "little") for v, n in ((40, 4), (w, 4), (h, 4), (1, 2), (24, 2), (0, 4), (len(rows), 4), (0, 16)))
    return b"BM" + head + info + rows


def intrinsic_modes(x: np.ndarray, most: int = 6, sifts: int = 8) -> list[np.ndarray]:
    """Empirical mode decomposition with linear envelopes: the modes, then the rest."""
    modes, rest = [], x.astype(float)
    for _ in range(most):
        h = rest.copy()
        for _ in range(sifts):
            d = np.diff(h)
            peaks = np.flatnonzero((d[:-1] > 0) & (d[1:] <= 0)) + 1
            dips = np.flatnonzero((d[:-1] < 0) & (d[1:] >= 0)) + 1
            if len(peaks) < 2 or len(dips) < 2:
                return [*modes, rest]
            t = np.arange(len(h))
            h = h - (np.interp(t, peaks, h[peaks]) + np.interp(t, dips, h[dips])) / 2
        modes.append(h)
        rest = rest - h
    return [*modes, rest]
