"""Streams of events: tumbling and sliding windows, sessions, and triggers whose state passes from batch to batch."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counted(events: DataFrame, size: str, slide: str | None = None, *, late: str = "10 minutes", keys: list[str] = ("event_type",)) -> DataFrame:
    """start, keys, n, total of windows; events later than the watermark are dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, *, late: str = "10 minutes", key: str = "user_id") -> DataFrame:
    """key, start, end, n of runs of events less than gap apart."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def triggers(samples: DataFrame) -> DataFrame:
    """rec, idx, code where a status channel changes to a code other than 0; samples: rec, idx, status.

    On a stream the last code of each recording is kept as state; on a table it is the row before.
    """
    if not samples.isStreaming:
        from pyspark.sql import Window

        code = F.col("status").bitwiseAND(0xFFFF)
        before = F.coalesce(F.lag(code).over(Window.partitionBy("rec").orderBy("idx")), F.lit(0))
        return samples.select("rec", "idx", code.alias("code"), before.alias("before")).where("code != before AND code != 0").select("rec", "idx", "code")

    def step(key, batches: Iterator, state):
        import pandas as pd

        last = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("idx", ignore_index=True)
        code = rows["status"].to_numpy() & 0xFFFF
        before = pd.Series(code).shift(1, fill_value=last).to_numpy()
        hit = (code != before) & (code != 0)
        state.update((int(code[-1]),))
        yield pd.DataFrame({"rec": key[0], "idx": rows["idx"].to_numpy()[hit], "code": code[hit]})

    return samples.groupBy("rec").applyInPandasWithState(step, "rec long, idx long, code long", "last long", "append", "NoTimeout")
