"""Acquisition parameters in words, from the JSON text of a recording's metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.metadata import field, numbers

# Directions of phase encoding in words.
DIRECTIONS = {"i": "left-right", "i-": "right-left", "j": "posterior-anterior", "j-": "anterior-posterior", "k": "inferior-superior", "k-": "superior-inferior"}


def _or(text: Column, missing: str) -> Column:
    return F.coalesce(text, F.lit(missing))


def _number(x: Column) -> Column:
    """A number without needless digits."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def repetition_time(data: Column) -> Column:
    """2.00 s."""
    tr = field(data, "RepetitionTime", "number")
    return F.when(tr.isNotNull(), F.format_string("%.2f s", tr)).otherwise("unknown")


def echo_times(data: Column) -> Column:
    """One or several in milliseconds: 12.0/30.5 ms."""
    x = numbers(data, "EchoTime")
    return F.when(F.size(x) > 0, F.concat(F.array_join(F.transform(x, lambda t: F.format_string("%.1f", t * 1000)), "/"), F.lit(" ms"))).otherwise("unknown")


def flip_angle(data: Column) -> Column:
    """90 degrees, with the sign."""
    return _or(F.concat(_number(field(data, "FlipAngle", "number")), F.lit("°")), "unknown")


def slice_timing(data: Column) -> Column:
    """Whether slices were taken at once or upwards, downwards, interleaved."""
    t = numbers(data, "SliceTiming")
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - 1, F.lit(1))), lambda k: F.get(t, k) - F.get(t, k - 1))
    words = F.when(F.size(t) < 2, "single slice").when(F.forall(steps, lambda d: F.abs(d) < 0.001), "sequential ascending").when(F.forall(steps, lambda d: d < -0.001), "sequential descending").otherwise("interleaved")
    return F.when(field(data, "SliceTiming", "list").isNull(), "unknown").otherwise(words)


def duration(volumes: Column, tr: Column) -> Column:
    """Minutes and seconds (5:02.50) of so many volumes, or seconds (30.0 s)."""
    total = volumes * tr
    minutes, rest = F.floor(total / 60), total % 60
    return _or(F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit(":"), F.lpad(F.format_string("%.2f", rest), 5, "0"))).when(total.isNotNull(), F.format_string("%.1f s", total)), "unknown")


def multiband(data: Column) -> Column:
    """The factor, or n/a."""
    return _or(field(data, "MultibandAccelerationFactor", "number").cast("bigint").cast("string"), "n/a")


def in_plane(data: Column) -> Column:
    """The factor of acceleration in the plane, or none."""
    return _or(_number(field(data, "ParallelReductionFactorInPlane", "number")), "none")


def matrix(data: Column) -> Column:
    """64×64 of the acquisition matrix."""
    x = numbers(data, "AcquisitionMatrixPE")
    return F.when(F.size(x) > 0, F.array_join(F.transform(x, lambda v: v.cast("bigint").cast("string")), "×")).otherwise("unknown")


def b_values(data: Column) -> Column:
    """0, 1000."""
    x = numbers(data, "bValues")
    return F.when(F.size(x) > 0, F.array_join(F.transform(x, lambda v: F.format_string("%.0f", v)), ", ")).otherwise("unknown")


def encoding_direction(data: Column) -> Column:
    """Phase encoding in words; other texts stay."""
    table = F.create_map(*[F.lit(x) for kv in DIRECTIONS.items() for x in kv])
    d = field(data, "PhaseEncodingDirection", "text")
    return _or(F.coalesce(F.try_element_at(table, d), d), "unknown")


def intended_targets(data: Column) -> Column:
    """The targets of a field map, joined, or none."""
    return _or(F.coalesce(field(data, "IntendedFor", "text"), F.array_join(field(data, "IntendedFor", "list"), ", ")), "none")
