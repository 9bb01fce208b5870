"""Haemodynamic responses: kernels on the driver, and the same densities as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Delay, undershoot, dispersion, dispersion of the undershoot, ratio.
SPM = (6.0, 16.0, 1.0, 1.0, 0.167)
GLOVER = (6.0, 12.0, 0.9, 0.9, 0.35)
#: Steps of the derivatives in time and in dispersion.
TIME_STEP, DISPERSION_STEP = 0.1, 0.01


def gamma_pdf(x: float, shape: float, loc: float = 0.0) -> float:
    """The gamma density of unit scale, shifted by loc."""
    x -= loc
    if x < 0 or shape <= 0:
        return 0.0
    if x == 0:
        return 1.0 if shape == 1 else 0.0 if shape > 1 else math.inf
    return math.exp((shape - 1) * math.log(x) - x - math.lgamma(shape))


def gamma_pdf_column(x: Column, shape: float, loc: float) -> Column:
    """gamma_pdf of a column, for shapes over 1."""
    t = x - loc
    return F.when(t > 0, F.exp((shape - 1) * F.log(t) - t - math.lgamma(shape))).otherwise(0.0)


def grid(tr: float, oversampling: int, length: float) -> tuple[int, float, float]:
    """The number of samples, their distance on the grid, and the step dt that shifts the densities."""
    dt = tr / oversampling
    n = int(length / dt + 0.5)
    return n, length / (n - 1) if n > 1 else 0.0, dt


def kernel_values(params: tuple, n: int, step: float, dt: float, onset: float = 0.0) -> list[float]:
    """The difference of two gamma densities at n times of a distance, before it is divided by its sum."""
    delay, under, disp, under_disp, ratio = params
    times = [k * step - onset for k in range(n)]
    return [0.0 if t <= 0 else gamma_pdf(t, delay / disp, dt / disp) - ratio * gamma_pdf(t, under / under_disp, dt / under_disp) for t in times]


def kernel(params: tuple, tr: float, oversampling: int = 50, length: float = 32.0, onset: float = 0.0) -> list[float]:
    """The difference of two gamma densities, its sum 1."""
    n, step, dt = grid(tr, oversampling, length)
    h = kernel_values(params, n, step, dt, onset)
    total = sum(h)
    return [x / total for x in h] if abs(total) > 1e-15 else h


def value_column(t: Column, params: tuple, dt: float) -> Column:
    """The difference of the densities at times t, before it is divided by its sum."""
    delay, under, disp, under_disp, ratio = params
    return F.when(t > 0, gamma_pdf_column(t, delay / disp, dt / disp) - ratio * gamma_pdf_column(t, under / under_disp, dt / under_disp)).otherwise(0.0)


def time_derivative(params: tuple, tr: float, oversampling: int = 50, length: float = 32.0) -> list[float]:
    """The kernel less the one TIME_STEP later, by that step."""
    return [(a - b) / TIME_STEP for a, b in zip(kernel(params, tr, oversampling, length), kernel(params, tr, oversampling, length, TIME_STEP), strict=True)]


def dispersion_derivative(params: tuple, tr: float, oversampling: int = 50, length: float = 32.0) -> list[float]:
    """The kernel less the one DISPERSION_STEP wider, by that step."""
    wider = (params[0], params[1], params[2] + DISPERSION_STEP, *params[3:])
    return [(a - b) / DISPERSION_STEP for a, b in zip(kernel(params, tr, oversampling, length), kernel(wider, tr, oversampling, length), strict=True)]


def kernels(model: str, tr: float, oversampling: int = 50, delays: list[int] = ()) -> list[list[float]]:
    """The kernels of a model: spm or glover, with ' + derivative' and ' + dispersion'; fir; none."""
    base, *more = [x.strip() for x in model.lower().split("+")]
    if base == "fir":
        return [[0.0] * (d * oversampling) + [1.0] * oversampling for d in delays]
    if base == "none":
        return [[1.0] + [0.0] * (oversampling - 1)]
    params = {"spm": SPM, "glover": GLOVER}[base]
    out = [kernel(params, tr, oversampling)]
    if "derivative" in more:
        out.append(time_derivative(params, tr, oversampling))
    if "dispersion" in more:
        out.append(dispersion_derivative(params, tr, oversampling))
    return out


def names(condition: str, model: str, delays: list[int] = ()) -> list[str]:
    """The names of a condition's regressors."""
    base, *more = [x.strip() for x in model.lower().split("+")]
    if base == "fir":
        return [f"{condition}_delay_{d}" for d in delays]
    return [condition, *[f"{condition}_{x}" for x in more]]
