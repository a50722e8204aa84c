"""Waveform and time-frequency kernels: numpy functions of arrays, and one wrapper that maps them over rows.

Matrices are (frame, bin) throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

EPS = 1e-12


def mapped(df: DataFrame, fn: Callable[..., dict], schema: str, keys: list[str], columns: list[str]) -> DataFrame:
    """A row of ``fn(arrays...)`` for each row, beside its keys; Arrow batches in and out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = zip(*[pdf[c].to_numpy() for c in columns], strict=True)
            rows = [fn(*[np.asarray(x, float) if isinstance(x, (list, np.ndarray)) else x for x in part]) for part in parts]
            yield pd.concat([pdf[keys].reset_index(drop=True), pd.DataFrame(rows)], axis=1) if rows else pd.DataFrame(columns=[*keys])

    return df.select(*dict.fromkeys([*keys, *columns])).mapInPandas(run, schema)


def hann(n: int) -> np.ndarray:
    """Periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def stft(x: np.ndarray, n: int = 64, hop: int = 16) -> np.ndarray:
    """Frames centred on multiples of ``hop``; the signal is reflected at its ends."""
    padded = np.pad(x, n // 2, mode="reflect" if x.size > n // 2 else "edge")
    starts = np.arange(0, padded.size - n + 1, hop)
    return np.fft.rfft(padded[starts[:, None] + np.arange(n)] * hann(n), axis=1)


def istft(z: np.ndarray, length: int, n: int = 64, hop: int = 16) -> np.ndarray:
    """Weighted overlap-add, normalised by the summed squared window."""
    frames = np.fft.irfft(z, n, axis=1) * hann(n)
    out, weight = np.zeros((len(z) - 1) * hop + n), np.zeros((len(z) - 1) * hop + n)
    for i, f in enumerate(frames):
        out[i * hop : i * hop + n] += f
        weight[i * hop : i * hop + n] += hann(n) ** 2
    body = (out / np.maximum(weight, EPS))[n // 2 :]
    return np.pad(body, (0, max(0, length - body.size)))[:length]


def db(power: np.ndarray | float) -> np.ndarray | float:
    return 10 * np.log10(np.maximum(power, EPS))


def band_db(x: np.ndarray, low: float, high: float, rate: float = 1.0) -> float:
    """Mean power of the bins in [low, high], in dB."""
    z = np.abs(stft(x)) ** 2
    f = np.fft.rfftfreq(64, 1 / rate)
    return float(db(z[:, (f >= low) & (f <= high)].mean()))


def onset_strength(x: np.ndarray, floor_db: float = -80.0) -> np.ndarray:
    """Positive change of each bin in dB between frames, summed over bins."""
    level = np.maximum(20 * np.log10(np.abs(stft(x)) + EPS), floor_db)
    return np.concatenate([[0.0], np.maximum(np.diff(level, axis=0), 0).sum(1)])


def onsets(strength: np.ndarray, k: float = 4.0, distance: int = 4) -> np.ndarray:
    """Local maxima over median + k MAD, the higher first, ``distance`` frames apart."""
    mid = np.median(strength)
    limit = mid + k * np.median(np.abs(strength - mid))
    inner = (strength[1:-1] > strength[:-2]) & (strength[1:-1] > strength[2:]) & (strength[1:-1] > limit)
    taken: list[int] = []
    for i in sorted(np.flatnonzero(inner) + 1, key=lambda i: (-strength[i], i)):
        if all(abs(i - j) >= distance for j in taken):
            taken.append(int(i))
    return np.array(sorted(taken), int)


def band_pass(x: np.ndarray, low: float, high: float, rate: float = 1.0) -> np.ndarray:
    """Zero-phase band pass: raised-cosine edges a quarter of the limits wide, in frequency."""
    f = np.fft.rfftfreq(x.size, 1 / rate)
    rise = np.clip((f - 0.75 * low) / (0.25 * low + EPS), 0, 1)
    fall = np.clip((1.25 * high - f) / (0.25 * high + EPS), 0, 1)
    return np.fft.irfft(np.fft.rfft(x) * (0.5 - 0.5 * np.cos(np.pi * rise)) * (0.5 - 0.5 * np.cos(np.pi * fall)), x.size)


def envelope(x: np.ndarray, smooth: int = 9) -> np.ndarray:
    w = hann(smooth + 1)[1:]
    return np.convolve(np.abs(x), w / w.sum(), "same")


def parabolic(v: np.ndarray, i: int) -> float:
    """Peak place between samples from the parabola through three."""
    if not 0 < i < v.size - 1:
        return float(i)
    a, b, c = v[i - 1 : i + 2]
    bend = a - 2 * b + c
    return float(i) if bend == 0 else i + 0.5 * (a - c) / bend


def delay(x: np.ndarray, y: np.ndarray, most: int, method: str = "ncc") -> tuple[float, float]:
    """Lag of y behind x within ``most`` samples, and the correlation there."""
    n = 1 << int(np.ceil(np.log2(x.size + y.size)))
    cross = np.conj(np.fft.rfft(x, n)) * np.fft.rfft(y, n)
    if method == "phat":
        cross /= np.abs(cross) + EPS
    c = np.fft.irfft(cross, n)
    c = np.concatenate([c[-most:], c[: most + 1]])
    if method == "ncc":
        c /= np.sqrt((x @ x) * (y @ y)) + EPS
    i = int(np.argmax(c))
    return parabolic(c, i) - most, float(c[i])


def warp(x: np.ndarray, at: np.ndarray, taps: int = 16) -> np.ndarray:
    """Values at fractional places by windowed sinc; zero beyond the ends."""
    base = np.floor(at).astype(int)
    k = np.arange(-taps + 1, taps + 1)
    place = base[:, None] + k
    d = at[:, None] - place
    kernel = np.sinc(d) * (0.5 + 0.5 * np.cos(np.pi * np.clip(d / taps, -1, 1)))
    ok = (place >= 0) & (place < x.size)
    return (np.where(ok, x[np.clip(place, 0, x.size - 1)], 0) * kernel).sum(1)


def cancel(y: np.ndarray, refs: list[np.ndarray], ridge: float = 1e-3) -> np.ndarray:
    """Remove from y what a per-bin ridge regression on the references explains."""
    target, parts = stft(y), [stft(r) for r in refs]
    out = np.empty_like(target)
    for b in range(target.shape[1]):
        a = np.stack([p[:, b] for p in parts], 1)
        gram = a.conj().T @ a
        gram += (ridge * np.trace(gram).real / len(refs) + EPS) * np.eye(len(refs))
        out[:, b] = target[:, b] - a @ np.linalg.solve(gram, a.conj().T @ target[:, b])
    return istft(out, y.size)


def percussive_mask(z: np.ndarray, width: int = 7, power: float = 2.0) -> np.ndarray:
    """Share of the median along bins (percussive) against the median along frames (harmonic)."""
    m = np.abs(z)
    pad = width // 2
    view = np.lib.stride_tricks.sliding_window_view
    harmonic = np.median(view(np.pad(m, ((pad, pad), (0, 0)), mode="edge"), width, axis=0), axis=-1)
    percussive = np.median(view(np.pad(m, ((0, 0), (pad, pad)), mode="edge"), width, axis=1), axis=-1)
    return percussive**power / (percussive**power + harmonic**power + EPS)


def wiener_gain(y: np.ndarray, noise: np.ndarray, floor: float = 0.1) -> np.ndarray:
    """Wiener gain with a floor, smoothed over three frames."""
    py, pn = np.abs(stft(y)) ** 2, np.abs(stft(noise)) ** 2
    g = np.maximum(1 - pn / np.maximum(py, EPS), floor)
    e = np.pad(g, ((1, 1), (0, 0)), mode="edge")
    return (e[:-2] + e[1:-1] + e[2:]) / 3


def soft_gate(x: np.ndarray, speech: np.ndarray, depth: float) -> np.ndarray:
    """Attenuate by ``depth`` where the interpolated probability of speech is high."""
    p = np.interp(np.arange(x.size), np.linspace(0, x.size - 1, speech.size), speech)
    return x * (1 - depth * np.clip(p, 0, 1))


def log_distance(a: np.ndarray, b: np.ndarray, sizes: tuple[int, ...] = (16, 32, 64)) -> float:
    """Mean absolute difference of log magnitudes over several window sizes."""
    parts = [np.abs(np.log(np.abs(stft(a, n, n // 4)) + 1e-5) - np.log(np.abs(stft(b, n, n // 4)) + 1e-5)).mean() for n in sizes]
    return float(np.mean(parts))


def bounded_mask(mix: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Real part of target over mix, in [0, 1]."""
    y, s = stft(mix), stft(target)
    return np.clip((s * y.conj()).real / (np.abs(y) ** 2 + EPS), 0, 1)


def complex_mask(mix: np.ndarray, target: np.ndarray) -> np.ndarray:
    y, s = stft(mix), stft(target)
    return s * y.conj() / (np.abs(y) ** 2 + EPS)


def paths(mask: np.ndarray, target: np.ndarray, nuisance: np.ndarray) -> dict[str, float]:
    """What a fixed mask does to each part of a mix, and how far the parts are from adding up."""
    n = target.size
    s, v = istft(mask * stft(target), n), istft(mask * stft(nuisance), n)
    both = istft(mask * stft(target + nuisance), n)
    energy = lambda x: float(x @ x)
    return {
        "target_kept_db": float(db(energy(s)) - db(energy(target))),
        "nuisance_cut_db": float(db(energy(nuisance)) - db(energy(v))),
        "residual": energy(both - s - v) / max(energy(both), EPS),
    }


def coherence(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Magnitude-squared coherence of each bin, over frames."""
    x, y = stft(a), stft(b)
    return np.abs((x * y.conj()).mean(0)) ** 2 / np.maximum((np.abs(x) ** 2).mean(0) * (np.abs(y) ** 2).mean(0), EPS)


def stereo(left: np.ndarray, right: np.ndarray) -> dict[str, float]:
    """Level difference, correlation, phase difference and delay of two channels."""
    x, y = stft(left), stft(right)
    norm = np.sqrt((left @ left) * (right @ right))
    return {
        "level_db": float(db(left @ left) - db(right @ right)),
        "correlation": float(left @ right / norm) if norm > 0 else 0.0,
        "phase": float(np.angle((x * y.conj()).sum())),
        "delay": delay(left, right, min(16, left.size - 1), "phat")[0],
    }


def transient(est: np.ndarray, ref: np.ndarray, decay_db: float = -20.0) -> dict[str, float]:
    """Rise and decay times of the loudest event in both, and the ratio of peaks."""

    def times(x: np.ndarray) -> tuple[int, int, float]:
        e = envelope(x)
        i = int(np.argmax(e))
        before, after = np.flatnonzero(e[: i + 1] <= 0.1 * e[i]), np.flatnonzero(e[i:] <= e[i] * 10 ** (decay_db / 20))
        return i - (int(before[-1]) if before.size else 0), int(after[0]) if after.size else e.size - i, float(e[i])

    (a, b, p), (c, d, q) = times(est), times(ref)
    return {"rise_error": a - c, "decay_error": b - d, "peak_ratio": p / max(q, EPS)}


def active_attenuation(raw: np.ndarray, out: np.ndarray, ref: np.ndarray) -> dict[str, float]:
    """Level change where the reference is in its loudest quarter of cells, and elsewhere."""
    r, a, b = np.abs(stft(ref)), np.abs(stft(raw)) ** 2, np.abs(stft(out)) ** 2
    active = r >= np.percentile(r, 75)
    change = lambda m: float(db(b[m].mean()) - db(a[m].mean())) if m.any() else float("nan")
    return {"active_db": change(active), "inactive_db": change(~active)}


def chunked(x: np.ndarray, fn: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Apply ``fn`` to half-overlapping chunks, joined by Hann weights; what no full chunk covers stays 0."""
    out, weight, w = np.zeros(x.size), np.zeros(x.size), hann(size) + 1e-6
    for a in range(0, x.size - size + 1, size // 2):
        out[a : a + size] += w * fn(x[a : a + size])
        weight[a : a + size] += w
    return np.where(weight > 0, out / np.maximum(weight, EPS), 0)


def augmented(x: np.ndarray, seed: int) -> np.ndarray:
    """Delay, gain, spectral tilt and a short decaying response, all drawn from the seed."""
    rng = np.random.default_rng(seed)
    y = np.concatenate([np.zeros(int(rng.integers(0, 8))), x])[: x.size] * 10 ** (rng.uniform(-6, 6) / 20)
    f = np.fft.rfftfreq(x.size)
    y = np.fft.irfft(np.fft.rfft(y) * 10 ** (rng.uniform(-3, 3) * (f - 0.25) / 10), x.size)
    response = np.concatenate([[1.0], 0.2 * rng.normal(size=8) * np.exp(-np.arange(8) / 2)])
    return np.convolve(y, response)[: x.size]


def delayed_copy(x: np.ndarray, ref: np.ndarray, low: int, high: int) -> tuple[int, float]:
    """Circular lag with ``low`` <= |lag| <= ``high`` of the largest correlation with the reference."""
    norm = np.sqrt((x @ x) * (ref @ ref)) + EPS
    lags = [k for k in range(-high, high + 1) if abs(k) >= low]
    values = [float(x @ np.roll(ref, k)) / norm for k in lags]
    i = int(np.argmax(np.abs(values)))
    return lags[i], values[i]


def comb_ripple(a: np.ndarray, b: np.ndarray) -> float:
    """Spread (95th less 5th percentile) over bins of the level ratio in dB."""
    ratio = db((np.abs(stft(a)) ** 2).mean(0)) - db((np.abs(stft(b)) ** 2).mean(0))
    return float(np.percentile(ratio, 95) - np.percentile(ratio, 5))


def optimised_mask(mix: np.ndarray, target: np.ndarray, steps: int = 40) -> tuple[np.ndarray, float, float]:
    """Real mask in [0, 1] of least waveform error, and the error before and after.

    Projected gradient with a fixed budget from the bounded mask; the step halves
    when the error would grow, so it never does.
    """
    y, n = stft(mix), target.size
    mask = bounded_mask(mix, target)

    def error(m: np.ndarray) -> tuple[float, np.ndarray]:
        left = istft(m * y, n) - target
        return float(left @ left), left

    first, left = error(mask)
    now, step = first, 1.0 / max(float((np.abs(y) ** 2).max()), EPS)
    for _ in range(steps):
        slope = (stft(left) * y.conj()).real
        while step > 1e-12:
            trial = np.clip(mask - step * slope, 0, 1)
            value, rest = error(trial)
            if value <= now:
                break
            step /= 2
        else:
            break
        mask, now, left, step = trial, value, rest, step * 1.5
    return mask, first, now


def coherence_by_loudness(a: np.ndarray, b: np.ndarray, block: int = 128) -> dict[str, float]:
    """Mean coherence of low and middle bins over the blocks in which b is louder than its median block, and the others."""
    rows = []
    for lo in range(0, a.size - block + 1, block):
        x, y = a[lo : lo + block], b[lo : lo + block]
        c = coherence(x, y)
        rows.append((float(db(np.mean(y**2))), c[1:8].mean(), c[8:24].mean()))
    rows = np.array(rows).reshape(-1, 3)
    loud = rows[:, 0] > np.median(rows[:, 0]) if len(rows) else np.zeros(0, bool)
    mean = lambda m, k: float(rows[m, k].mean()) if m.any() else None
    return {"loud_low": mean(loud, 1), "quiet_low": mean(~loud, 1), "loud_mid": mean(loud, 2), "quiet_mid": mean(~loud, 2)}


def friction(est: np.ndarray, ref: np.ndarray, hop: int = 8) -> dict[str, float]:
    """Correlation of block envelopes and mean log-spectral distance inside an interval."""
    blocks = lambda x: np.abs(x)[: x.size // hop * hop].reshape(-1, hop).mean(1)
    a, b = blocks(ref), blocks(est)
    r = float(np.corrcoef(a, b)[0, 1]) if a.size > 1 and a.std() > 0 and b.std() > 0 else None
    return {"envelope_r": r, "log_distance": float(np.abs(np.log(np.abs(stft(ref)) + EPS) - np.log(np.abs(stft(est)) + EPS)).mean())}


def frame_features(frame: np.ndarray, previous: np.ndarray | None) -> dict[str, float]:
    """Colour-mask shares, brightness and change of an RGB frame (h, w, 3)."""
    f = frame.astype(float)
    red, green, blue = f[..., 0], f[..., 1], f[..., 2]
    return {
        "warm": float(((red > 1.2 * blue) & (red > 80)).mean()),
        "white": float(((f.min(-1) > 180) & (f.max(-1) - f.min(-1) < 30)).mean()),
        "bright": float(f.mean()),
        "diff": 0.0 if previous is None else float(np.abs(f - previous).mean()),
    }
