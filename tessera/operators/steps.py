"""Preprocessing as a list of steps: a plan over long samples, kept as JSON.

Steps before the first epoch step work on whole recordings, those after it on each epoch. Normalisation and
baseline have no meaning before epochs and do nothing there. Without an epoch step a recording is one epoch.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import filters
from tessera.operators import recordings, signal

#: What a step is called, and its parameters.
STEPS = {
    "pick": ("channels",), "drop": ("channels",), "average_reference": (), "reference": ("channel",), "bandpass": ("low", "high", "order"), "highpass": ("cutoff", "order"),
    "lowpass": ("cutoff", "order"), "notch": ("frequency",), "resample": ("rate",), "epoch": ("label", "start", "end"), "baseline": ("start", "end"), "z_score": (), "min_max": (),
}
_EPOCH_ONLY = ("baseline", "z_score", "min_max")


@dataclass(frozen=True)
class Steps:
    """A named list of (step, parameters)."""

    name: str = ""
    steps: tuple[tuple[str, dict], ...] = field(default=())

    def then(self, step: str, **parameters) -> Steps:
        """The list with one more step; unknown steps and parameters raise."""
        if step not in STEPS or set(parameters) != set(STEPS[step]):
            raise ValueError(f"{step} takes {STEPS.get(step, 'nothing: it is unknown')}, not {sorted(parameters)}")
        return Steps(self.name, (*self.steps, (step, parameters)))

    def to_json(self) -> str:
        """The list as JSON."""
        return json.dumps({"name": self.name, "steps": [{"step": s, **p} for s, p in self.steps]}, indent=2)

    @staticmethod
    def from_json(text: str) -> Steps:
        """The list that to_json() wrote."""
        spec = json.loads(text)
        out = Steps(spec.get("name", ""))
        for x in spec["steps"]:
            out = out.then(x["step"], **{k: v for k, v in x.items() if k != "step"})
        return out

    def run(self, s: DataFrame, rate: float, events: DataFrame | None = None, by: tuple[str, ...] = ("rec",)) -> tuple[DataFrame, float]:
        """by, epoch, label, ch, idx, value, and the rate at the end. s: by, ch, idx, value; events: by, event_id, onset, trial_type."""
        by, kinds = list(by), [k for k, _ in self.steps]
        first = kinds.index("epoch") if "epoch" in kinds else len(kinds)
        for step, p in self.steps[:first]:
            s, rate = (s, rate) if step in _EPOCH_ONLY else _applied(s, step, p, rate, by)
        cut = [p for k, p in self.steps if k == "epoch"]
        e = _epochs(s, events, cut, rate, by) if cut else s.withColumn("epoch", F.lit(0).cast("bigint")).withColumn("label", F.lit("_whole_"))
        for step, p in self.steps[first:]:
            if step != "epoch":
                e, rate = _applied(e, step, p, rate, [*by, "epoch", "label"])
        return e.select(*by, "epoch", "label", "ch", "idx", "value"), rate


def _epochs(s: DataFrame, events: DataFrame, cut: list[dict], rate: float, by: list[str]) -> DataFrame:
    out = None
    for p in cut:
        marks = events.where(F.col("trial_type") == p["label"]).select(*by, "event_id", F.col("trial_type").alias("label"), F.round(F.col("onset") * rate).cast("int").alias("at"))
        part = signal.event_epochs(s, marks, signal.round_half_up(p["start"] * rate), signal.round_half_up(p["end"] * rate), by).withColumn("epoch", F.col("event_id").cast("bigint")).drop("event_id", "at")
        out = part if out is None else out.unionByName(part)
    return out


def _applied(s: DataFrame, step: str, p: dict, rate: float, by: list[str]) -> tuple[DataFrame, float]:
    keys = [*by, "ch"]
    if step == "pick":
        return recordings.pick_channels(s, names=p["channels"]).drop("place"), rate
    if step == "drop":
        return recordings.pick_channels(s, exclude=p["channels"]), rate
    if step == "average_reference":
        return signal.average_reference(s, by), rate
    if step == "reference":
        return signal.channel_reference(s, p["channel"], by), rate
    if step == "baseline":
        return signal.baseline(s, signal.round_half_up(max(0.0, p["start"]) * rate), signal.round_half_up(max(0.0, p["end"]) * rate), keys), rate
    if step == "z_score":
        return signal.z_score(s, keys, population=True), rate
    if step == "min_max":
        return signal.min_max(s, keys), rate
    if step == "notch":
        return signal.notch(s, p["frequency"], rate, keys=keys), rate
    if step == "resample":
        return signal.resample(s, rate, p["rate"], keys), p["rate"]
    half = rate / 2
    if step == "bandpass":
        b, a = filters.butter_bandpass(p["order"], p["low"] / half, p["high"] / half)
    else:
        b, a = (filters.butter_highpass if step == "highpass" else filters.butter_lowpass)(p["order"], p["cutoff"] / half)
    return signal.iir(s, b.tolist(), a.tolist(), keys), rate


def classes(e: DataFrame) -> DataFrame:
    """label, code: the labels of epochs in sorted order, numbered from 0."""
    labels = e.select("label").distinct()
    #: As many rows as there are labels.
    return labels.agg(F.array_sort(F.collect_set("label")).alias("all")).select(F.posexplode("all").alias("code", "label")).select("label", "code")


def features(e: DataFrame, by: tuple[str, ...] = ("rec",)) -> DataFrame:
    """by, epoch, label and values: an epoch's channels one after another."""
    return e.groupBy(*by, "epoch", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("ch", "idx", "value"))), lambda x: x.value).alias("values"))


# Presets of paradigms (pass band, events, window in seconds, rate).
PARADIGMS = {
    "motor_imagery": ((8.0, 30.0), (), 0.0, None, None), "p300": ((1.0, 24.0), ("Target", "NonTarget"), 0.0, 0.8, None), "ssvep": ((7.0, 45.0), (), 0.0, None, None),
    "resting_state": ((1.0, 35.0), (), 10.0, 50.0, 128.0), "fixed_interval": ((1.0, 45.0), (), 0.0, None, None), "custom": (None, (), 0.0, None, None),
}


def paradigm(name: str, *, events: tuple[str, ...] | None = None, end: float | None = None, order: int = 4) -> Steps:
    """The steps of a preset: its pass band, its rate, and an epoch for each of its events."""
    band, own, start, own_end, rate = PARADIGMS[name]
    out, until = Steps(name), own_end if end is None else end
    if band:
        out = out.then("bandpass", low=band[0], high=band[1], order=order)
    if rate:
        out = out.then("resample", rate=rate)
    for e in own if events is None else events:
        out = out.then("epoch", label=e, start=start, end=until)
    return out


def label_encoded(df: DataFrame, label: Column, name: str = "code") -> DataFrame:
    """df with the number of each row's label, the labels in sorted order from 0. Labels are a small table, joined by size."""
    all_ = df.select(label.alias("_label")).where("_label IS NOT NULL").distinct().agg(F.array_sort(F.collect_set("_label")).alias("a")).select(F.posexplode("a").alias(name, "_label"))
    return df.withColumn("_label", label).join(all_, "_label", "left").drop("_label")
