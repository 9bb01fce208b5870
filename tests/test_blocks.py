"""Filters, resampling and spectra by blocks against the same on whole channels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import filters
from tessera.operators import signal

SCHEMA = "rec int, ch string, idx int, value double"


@pytest.fixture(scope="module")
def series():
    draw = np.random.default_rng(7)
    return {(r, c): draw.normal(size=n).cumsum() for r, n in enumerate((1, 2, 9, 60, 61, 120, 121, 299, 733)) for c in "ab"}


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(signal, "BLOCK", 60)
    monkeypatch.setattr(filters, "STRETCH", 8)


def frame(spark, series, step=1, shift=0):
    return spark.createDataFrame([(r, c, shift + step * k, float(v)) for (r, c), x in series.items() for k, v in enumerate(x)], SCHEMA).repartition(6)


def collected(out, value="value", idx="idx"):
    got = {}
    for r in out.collect():
        assert r[idx] not in got.setdefault((r.rec, r.ch), {})
        got[r.rec, r.ch][r[idx]] = r[value]
    return got


def same(got, want):
    assert set(got) == {k for k, v in want.items() if len(v)}
    for k, x in want.items():
        assert len(got.get(k, ())) == len(x), k
        assert [np.nan if got[k][i] is None else got[k][i] for i in range(len(x))] == pytest.approx(np.asarray(x).tolist(), rel=1e-9, abs=1e-9, nan_ok=True), k


@pytest.mark.parametrize("zero_phase", [True, False])
@pytest.mark.parametrize("design", [filters.butter_lowpass(2, 0.1), filters.butter_bandpass(4, 0.05, 0.6), ([0.5, 0.25, 0.25], [2.0]), ([3.0], [1.0])])
def test_filters(spark, series, small, zero_phase, design):
    b, a = (np.asarray(x).tolist() for x in design)
    f = filters.filtfilt if zero_phase else filters.lfilter
    want = {k: f(b, a, x) for k, x in series.items()}
    same(collected(signal.iir(frame(spark, series), b, a, zero_phase=zero_phase)), want)


def test_numbers_with_gaps_are_closed(spark, series, small):
    b, a = filters.butter_lowpass(2, 0.3)
    same(collected(signal.iir(frame(spark, series, 7, 500), b.tolist(), a.tolist())), {k: filters.filtfilt(b, a, x) for k, x in series.items()})


def test_notch(spark, series, small):
    want = {}
    for k, x in series.items():
        for h in (10.0, 20.0, 30.0):
            x = filters.filtfilt(*filters.notch(h, 64.0, 30.0), x)
        want[k] = x
    same(collected(signal.notch(frame(spark, series), 10.0, 64.0)), want)


@pytest.mark.parametrize("rates", [(64.0, 24.0), (64.0, 100.0), (50.0, 9.0), (10.0, 10.0)])
def test_resample(spark, series, small, rates):
    same(collected(signal.resample(frame(spark, series), *rates)), {k: filters.resample(x, *rates) for k, x in series.items()})


@pytest.mark.parametrize("n_fft", [16, 17, 1, 100, 61])
def test_welch(spark, series, small, n_fft):
    def power(x):
        size = min(n_fft, len(x))
        win = np.hanning(size) if size > 1 else np.ones(size)
        starts = range(0, len(x) - size + 1, max(1, size // 2)) if len(x) >= n_fft else [0]
        starts = range(0, len(x) - size + 1, max(1, n_fft // 2)) if len(x) >= n_fft else starts
        return np.mean([np.abs(np.fft.rfft(x[k : k + size] * win)) ** 2 for k in starts], axis=0) / (win**2).sum()

    got = collected(signal.welch(frame(spark, series), n_fft), "psd", "bin")
    same(got, {k: power(x) for k, x in series.items()})


def test_states_over_many_samples():
    b, a = filters.butter_bandpass(3, 0.1, 0.4)
    x, z = np.random.default_rng(1).normal(size=(2, 5000)), np.random.default_rng(2).normal(size=(2, len(a) - 1))
    y, after = filters.lfilter_from(b, a, x, z)
    slow, state = filters._steps(b, a, x, z.T.copy())
    assert np.allclose(y, slow) and np.allclose(after, state.T)
    power, back = filters.transfer(b, a, 77)
    free, state = filters._steps(b, a, np.zeros((2, 77)), z.T.copy())
    assert np.allclose(z @ power.T, state.T)
    assert np.allclose(z @ back.T, filters._steps(b, a, free[:, ::-1], np.zeros((len(a) - 1, 2)))[1].T)


def test_a_long_channel_in_real_blocks(spark):
    n = 3 * signal.BLOCK + 12_345
    s = spark.range(n).selectExpr("1 AS rec", "'a' AS ch", "CAST(id AS INT) AS idx", "sin(id / 50) + (id * 7919 % 101) / 100 AS value")
    b, a = filters.butter_bandpass(2, 0.01, 0.2)
    i = np.arange(n)
    x = np.sin(i / 50) + (i * 7919 % 101) / 100
    got = signal.iir(s, b.tolist(), a.tolist()).toPandas().sort_values("idx")
    want = filters.filtfilt(b, a, x)
    assert got["idx"].tolist() == i.tolist() and np.abs(got["value"].to_numpy() - want).max() < 1e-8


def test_channels_with_rates_of_their_own(spark, series):
    from tessera.operators import recordings

    rates = {r: (24.0, 64.0, 100.0, 64.005)[r % 4] for r, _ in series}
    table = spark.createDataFrame(list(rates.items()), "rec int, rate double")
    want = {k: x if abs(rates[k[0]] - 64) <= 0.01 else filters.resample(x, rates[k[0]], 64.0) for k, x in series.items()}
    same(collected(recordings.harmonised_rates(frame(spark, series), table, 64.0, ["rec", "ch"])), want)


def test_functions_of_the_user_in_labels_and_predicates(spark):
    import pandas as pd

    from tessera.operators import datasets

    @F.pandas_udf("string")
    def label(subject: pd.Series) -> pd.Series:
        return subject.map(lambda s: "even" if int(s) % 2 == 0 else "odd")

    files = spark.createDataFrame([(f"{k:02d}", f"/d/{k}") for k in range(9)], "subject string, path string")
    m = datasets.manifest(files, F.lit("d")).withColumn("label", label("subject"))
    assert {(r.label, r.n) for r in datasets.label_distribution(m, "label").collect()} == {("even", 5), ("odd", 4)}
    assert m.where(label("subject") == "odd").count() == 4
