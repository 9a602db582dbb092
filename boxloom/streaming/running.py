"""Streams: the running mean of losses and the memory of the last batches, as stateful operators. Extensions for unbounded input."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_loss(events: DataFrame, time: str = "ts", by: str = "event_type", value: str = "value", window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Mean and count of values in windows of event time; rows later than late are dropped."""
    w = events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), by)
    return w.agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "mean", "n")


def last_mean(events: DataFrame, by: str = "event_type", order: str = "event_id", value: str = "value", width: int = 1000) -> DataFrame:
    """For each batch and key, the mean of the last width values seen; the state is those values."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(order)
        kept = (kept + rows[value].tolist())[-width:]
        state.update((kept,))
        yield pd.DataFrame({"key": [str(key[0])], "n": [len(kept)], "mean": [sum(kept) / len(kept)]})

    return events.groupBy(by).applyInPandasWithState(step, "key string, n long, mean double", "kept array<double>", "update", GroupStateTimeout.NoTimeout)


def memory_bank(batches: DataFrame, by: str = "label", step_column: str = "step", item: str = "vec_id", steps: int = 3, most: int = 512) -> DataFrame:
    """For each key, the items of its last steps steps, at most most, the newest first; what is older is forgotten before new ones come in."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        rows = pd.concat(list(frames))
        held += list(zip(rows[step_column].tolist(), rows[item].tolist()))
        newest = sorted({s for s, _ in held})[-steps:]
        held = sorted((x for x in held if x[0] in newest), key=lambda x: (-x[0], x[1]))[:most]
        state.update(([s for s, _ in held], [i for _, i in held]))
        yield pd.DataFrame({"key": [str(key[0])], "oldest": [min(newest)], "n": [len(held)]})

    return batches.groupBy(by).applyInPandasWithState(step, "key string, oldest long, n long", "steps array<long>, items array<long>", "update", GroupStateTimeout.NoTimeout)
