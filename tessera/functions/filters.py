"""Digital filters in numpy: designs on the driver, kernels for one channel in a task."""

from __future__ import annotations

from fractions import Fraction
from functools import lru_cache

import numpy as np


def butter_lowpass(order: int, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """b, a of a Butterworth low-pass by the bilinear transform; cutoff as a part of half the rate; gain 1 at 0."""
    if not 0 < cutoff < 1:
        raise ValueError(f"cutoff must be in (0, 1), got {cutoff}")
    angles = np.pi * (2 * np.arange(order) + order + 1) / (2 * order)
    s = np.exp(1j * angles) * np.tan(np.pi * cutoff / 2)
    a = np.poly((1 + s) / (1 - s)).real
    b = np.poly(-np.ones(order)).real
    return b * (a.sum() / b.sum()), a


def butter_highpass(order: int, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """The low-pass of the same cutoff mirrored, gain 1 at half the rate."""
    b, a = butter_lowpass(order, cutoff)
    sign = (-1.0) ** np.arange(order + 1)
    b, a = b * sign, a * sign
    return b * ((a * sign).sum() / (b * sign).sum()), a


def butter_bandpass(order: int, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """A high-pass at low followed by a low-pass at high."""
    if not 0 < low < high < 1:
        raise ValueError(f"0 < low < high < 1 must hold, got {low}, {high}")
    (b1, a1), (b2, a2) = butter_highpass(order, low), butter_lowpass(order, high)
    return np.convolve(b1, b2), np.convolve(a1, a2)


def notch(hertz: float, rate: float, quality: float) -> tuple[np.ndarray, np.ndarray]:
    """b, a with zeros at the frequency, poles just inside, gain 1 at 0."""
    w = 2 * np.pi * hertz / rate
    r = 1 - w / quality / 2
    b, a = np.array([1, -2 * np.cos(w), 1]), np.array([1, -2 * r * np.cos(w), r * r])
    return b * (a.sum() / b.sum()), a


def _even(b, a) -> tuple[np.ndarray, np.ndarray]:
    """b and a of one length, divided by a[0]."""
    n = max(len(a), len(b))
    return np.pad(np.asarray(b, float), (0, n - len(b))) / a[0], np.pad(np.asarray(a, float), (0, n - len(a))) / a[0]


def _steps(b, a, x, state) -> tuple[np.ndarray, np.ndarray]:
    """y and the state after it, transposed direct form II; all signals [..., sample] take a step together. state: [order, ...]."""
    y = np.empty(x.shape[::-1])
    state = np.concatenate([state, np.zeros((1, *state.shape[1:]))])
    for i, v in enumerate(x.T):
        out = y[i] = b[0] * v + state[0]
        state[:-1] = np.multiply.outer(b[1:], v) - np.multiply.outer(a[1:], out) + state[1:]
    return y.T, state[:-1]


def lfilter(b, a, x) -> np.ndarray:
    """The recursion from rest along the last axis."""
    b, a = _even(b, a)
    x = np.asarray(x, float)
    return _steps(b, a, x, np.zeros((len(a) - 1, *x.shape[:-1][::-1])))[0]


def transfer(b, a, n: int) -> tuple[np.ndarray, np.ndarray]:
    """What n samples without input make of a state: the state after them, and that of a backward pass over their output.

    Both are matrices, from powers of one step's: n steps are split by the bits of n. Powers of a filter with close poles
    grow far before they fall, so they are worked out in whole numbers with PLACES binary places.
    """
    b, a = _even(b, a)
    return _transfer(tuple(b.tolist()), tuple(a.tolist()), n)


PLACES = 256


@lru_cache(256)
def _transfer(b: tuple, a: tuple, n: int) -> tuple[np.ndarray, np.ndarray]:
    order = len(a) - 1
    if not order:
        return np.zeros((0, 0)), np.zeros((0, 0))
    whole = np.vectorize(lambda x: int(Fraction(x) * (1 << PLACES)), otypes=[object])
    back_to_float = np.vectorize(lambda x: float(Fraction(x, 1 << PLACES)), otypes=[float])

    def times(p, q):
        return (p @ q) >> PLACES

    one = whole(np.eye(order, k=1))
    one[:, 0] -= whole(np.array(a[1:]))
    gain = whole(np.array(b[1:])) - ((whole(np.array(a[1:])) * int(Fraction(b[0]) * (1 << PLACES))) >> PLACES)
    step_both = np.full((order, order), 0, object)
    step_both[:, 0] = gain
    step_power, power, both = one, whole(np.eye(order)), np.full((order, order), 0, object)
    while n:
        if n & 1:
            both = both + times(times(power, step_both), power)
            power = times(power, step_power)
        step_both = step_both + times(times(step_power, step_both), step_power)
        step_power = times(step_power, step_power)
        n >>= 1
    return back_to_float(power), back_to_float(both)


#: Samples that lfilter_from takes one by one; all stretches of a longer signal take them together.
STRETCH = 512


def lfilter_from(b, a, x, state) -> tuple[np.ndarray, np.ndarray]:
    """y and the state after it of signals [signal, sample] that begin in states [signal, order].

    Long signals are cut in stretches that are filtered from rest together; then each stretch's true state follows from
    the one before, and what that state adds is known for all samples.
    """
    b, a = _even(b, a)
    x, state = np.asarray(x, float), np.asarray(state, float)
    m, order = x.shape[1] // STRETCH, len(a) - 1
    if m < 4 or not order:
        y, after = _steps(b, a, x, state.T.copy())
        return y, after.T
    parts = x[:, : m * STRETCH].reshape(-1, STRETCH)
    y, gained = _steps(b, a, parts, np.zeros((order, len(parts))))
    y, gained = y.reshape(len(x), m, STRETCH), gained.T.reshape(len(x), m, order)
    power = transfer(b, a, STRETCH)[0]
    free = _steps(b, a, np.zeros((order, STRETCH)), np.eye(order))[0]
    begun = np.empty((len(x), m, order))
    for k in range(m):
        begun[:, k] = state
        state = state @ power.T + gained[:, k]
    y = (y + begun @ free).reshape(len(x), -1)
    rest, after = _steps(b, a, x[:, m * STRETCH :], state.T.copy())
    return np.concatenate([y, rest], axis=1), after.T


def filtfilt(b, a, x) -> np.ndarray:
    """Forward and backward from rest, on the signals continued at both ends by their point reflection."""
    x = np.asarray(x, float)
    n = x.shape[-1]
    if not n:
        return x
    pad = min(3 * max(len(a), len(b)), n - 1)
    longer = np.concatenate([2 * x[..., :1] - x[..., 1 : pad + 1][..., ::-1], x, 2 * x[..., -1:] - x[..., n - 1 - pad : n - 1][..., ::-1]], axis=-1)
    return lfilter(b, a, lfilter(b, a, longer)[..., ::-1])[..., ::-1][..., pad : pad + n]


def resample(x, old_rate: float, new_rate: float) -> np.ndarray:
    """round(length * ratio) samples by linear interpolation; low-passed with order 8 before the rate falls."""
    x = np.asarray(x, float)
    n = x.shape[-1]
    if not n or old_rate <= 0 or new_rate <= 0 or abs(old_rate - new_rate) < 1e-10:
        return x
    ratio = new_rate / old_rate
    if ratio < 1:
        x = filtfilt(*butter_lowpass(8, min(0.99, ratio)), x)
    at = np.arange(int(n * ratio + 0.5)) / ratio
    at = at[at < n]
    low = np.minimum(at.astype(int), n - 1)
    high, part = np.minimum(low + 1, n - 1), at - low
    return x[..., low] * (1 - part) + x[..., high] * part
