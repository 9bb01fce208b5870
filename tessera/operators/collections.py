"""Sparse and dense variables of runs together, with instructions that may turn one kind into the other.

Sparse variables are columns of an event table (keys, onset, duration, event_id), dense ones columns of a table of bins
(keys, bin) at one rate. A planner knows each variable's kind: an instruction whose inputs are of both kinds first
turns the sparse ones into dense ones, ToDense does so by name, Resample changes the rate of all that are dense.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import signal, variables

EVENT, BIN = ("onset", "duration", "event_id"), ("bin",)


@dataclass(frozen=True)
class Collection:
    """keys of a run; sparse and dense tables (either may be missing); bins a second of the dense one."""

    keys: list[str]
    sparse: DataFrame | None = None
    dense: DataFrame | None = None
    rate: float | None = None

    def kinds(self) -> dict[str, str]:
        """Each variable's kind; a name that is both is an error."""
        sparse = [c for c in self.sparse.columns if c not in (*self.keys, *EVENT)] if self.sparse is not None else []
        dense = [c for c in self.dense.columns if c not in (*self.keys, *BIN)] if self.dense is not None else []
        if both := set(sparse) & set(dense):
            raise ValueError(f"sparse and dense at once: {sorted(both)}")
        return dict.fromkeys(sparse, "sparse") | dict.fromkeys(dense, "dense")

    def plan(self, instructions: list[dict]) -> list[tuple[str, object]]:
        """What is done, in order: ("convert", names), ("resample", rate), ("sparse" or "dense", instruction).

        Kinds are followed through the instructions' outputs, without touching any row.
        """
        kinds, steps = self.kinds(), []
        for raw in instructions:
            i = {k.lower(): v for k, v in raw.items()}
            name, inputs = i["name"].lower(), variables._names(i.get("input", []))
            if unknown := [c for c in inputs if c not in kinds]:
                raise ValueError(f"{i['name']}: unknown variables {unknown}")
            if name == "todense":
                inputs = inputs or [c for c, k in kinds.items() if k == "sparse"]
                wanted = [c for c in inputs if kinds[c] == "sparse"]
                steps.append(("convert", (wanted, i.get("samplingrate", i.get("sampling_rate")))))
                kinds |= dict.fromkeys(wanted, "dense")
            elif name == "resample":
                steps.append(("resample", float(i.get("samplingrate", i.get("sampling_rate")))))
                late = [c for c in inputs if kinds[c] == "sparse"]
                if late:
                    steps.insert(-1, ("convert", (late, None)))
                    kinds |= dict.fromkeys(late, "dense")
            else:
                others = variables._names(i["other"]) if "other" in i else []
                used = [*inputs, *(c for c in [*others, i.get("by")] if isinstance(c, str) and c in kinds)]
                kind = "dense" if any(kinds[c] == "dense" for c in used) else "sparse"
                late = [c for c in used if kinds[c] == "sparse"] if kind == "dense" else []
                if late:
                    steps.append(("convert", (late, None)))
                    kinds |= dict.fromkeys(late, "dense")
                steps.append((kind, raw))
                outputs = variables._names(i.get("output", inputs))
                if name in ("rename", "delete"):
                    kinds = {c: k for c, k in kinds.items() if c not in inputs}
                if name == "select":
                    kinds = {c: k for c, k in kinds.items() if k != kind or c in inputs}
                if name in ("factor", "split"):
                    kinds |= {f"{c}.{v}": kind for c in inputs for v in i.get("levels", [])}
                elif name != "delete":
                    kinds |= dict.fromkeys(outputs, kind)
        return steps

    def run(self, instructions: list[dict]) -> Collection:
        """The collection after the instructions."""
        c = self
        for what, detail in self.plan(instructions):
            if what == "convert":
                c = c.converted(*detail)
            elif what == "resample":
                c = c.resampled(detail)
            else:
                order = [*self.keys, *(EVENT[::2] if what == "sparse" else BIN)]
                fixed = [*self.keys, *(EVENT if what == "sparse" else BIN)]
                c = replace(c, **{what: variables.transform(getattr(c, what), [detail], fixed if detail.get("Name", detail.get("name", "")).lower() == "select" else order, self.keys)})
        return c

    def converted(self, names: list[str], rate: float | None = None) -> Collection:
        """Sparse variables as dense ones: bins without an event are 0, up to the run's last bin of any variable."""
        if rate is not None and self.dense is not None and float(rate) != self.rate:
            raise ValueError(f"dense variables have a rate of {self.rate}, not {rate}: resample first")
        rate = float(rate if rate is not None else self.rate or 0)
        if rate <= 0 or rate != int(rate):
            raise ValueError(f"a whole number of bins a second is needed, not {rate}")
        if not names:
            return replace(self, rate=rate)
        made = variables.painted(self.sparse, names, int(rate), self.keys)
        old = [c for c in self.dense.columns if c not in (*self.keys, "bin")] if self.dense is not None else []
        if self.dense is not None:
            made = made.unionByName(self.dense.withColumn("bin", F.col("bin").cast("long")), allowMissingColumns=True)
        #: Dealt by runs before bins meet, so that the grid needs no other shuffle. Each table is read once: a plan that read
        #: it twice would double with every conversion.
        made = made.where("bin >= 0").repartition(*self.keys).groupBy(*self.keys, "bin").agg(*[F.max(f"`{c}`").alias(c) for c in [*old, *names]])
        return replace(self, sparse=self.sparse.drop(*names), dense=self._filled(made, [*old, *names]), rate=rate)

    def _filled(self, made: DataFrame, names: list[str]) -> DataFrame:
        """Every run's whole grid, from 0 to its last bin: a row stands for the bins up to the next one, too, a run's first for those before it."""
        place = Window.partitionBy(*self.keys).orderBy("bin")
        first = F.when(F.row_number().over(place) == 1, F.lit(0).cast("long")).otherwise(F.col("bin"))
        last = F.coalesce(F.lead("bin").over(place) - 1, F.col("bin"))
        rows = made.withColumns({"_first": first, "_last": last}).withColumn("_bin", F.explode(F.sequence("_first", "_last")))
        #: As in a join, a key that is missing is equal to none: its run has bins, but no variables.
        own = F.col("_bin") == F.col("bin")
        for k in self.keys:
            own = own & F.col(k).isNotNull()
        return rows.select(*self.keys, F.col("_bin").alias("bin"), *[F.when(own, F.coalesce(F.col(f"`{c}`"), F.lit(0.0))).otherwise(0.0).alias(c) for c in names])

    def resampled(self, rate: float) -> Collection:
        """All dense variables at another rate."""
        if self.dense is None or self.rate is None:
            raise ValueError("there are no dense variables to resample")
        names = [c for c in self.dense.columns if c not in (*self.keys, "bin")]
        if self.rate > 0 and rate > self.rate:
            return replace(self, dense=self._interpolated(names, rate / self.rate), rate=float(rate))
        long = self.dense.unpivot([*self.keys, "bin"], names, "name", "value").withColumnRenamed("bin", "idx")
        made = signal.resample(long, self.rate, rate, [*self.keys, "name"])
        return replace(self, dense=made.withColumnRenamed("idx", "bin").groupBy(*self.keys, "bin").pivot("name", names).agg(F.max("value")), rate=float(rate))

    def _interpolated(self, names: list[str], ratio: float) -> DataFrame:
        """signal.resample() to a higher rate, which filters nothing, of all variables at once: a bin and the next give the new ones between them."""
        place = Window.partitionBy(*self.keys).orderBy("bin")
        at = (F.row_number().over(place) - 1).cast("long")
        rows = self.dense.withColumns({"_at": at, "_end": F.lead("bin").over(place).isNull(), **{f"_next_{c}": F.lead(f"`{c}`").over(place) for c in names}})
        new = F.sequence(F.greatest(F.floor(F.col("_at") * ratio) - 1, F.lit(0).cast("long")), F.floor((F.col("_at") + 1) * ratio) + 1)
        rows = rows.withColumn("_new", F.explode(new)).withColumn("_part", F.col("_new") / F.lit(ratio) - F.col("_at")).where("_part >= 0 AND _part < 1")
        #: A run's last bin has no next one; its new bins end where the length, rounded, does.
        rows = rows.where(~F.col("_end") | (F.col("_new") < F.floor((F.col("_at") + 1) * ratio + 0.5)))
        part, own = F.col("_part"), lambda c: F.col(f"`{c}`").cast("double")
        between = lambda c: own(c) * (1 - part) + F.when(F.col("_end"), own(c)).otherwise(F.col(f"`_next_{c}`")) * part
        return rows.select(*self.keys, F.col("_new").cast(self.dense.schema["bin"].dataType).alias("bin"), *[between(c).alias(c) for c in names])

    def table(self) -> DataFrame:
        """The dense variables if there are any, else the sparse ones."""
        return self.dense if self.dense is not None else self.sparse
