"""Rate limits: sliding counts, and admission where refused requests are not recorded."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    minute: int = 60
    hour: int = 1000
    day: int = 10_000
    burst: int = 10

    def checks(self) -> list[tuple[int, int, str]]:
        """(seconds, most, name) in the order they are checked."""
        return [(60, self.minute, "minute"), (3600, self.hour, "hour"), (86_400, self.day, "day"), (1, self.burst, "burst")]


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def sliding_counts(events: DataFrame, user: str, ts: str, seconds: tuple[int, ...] = (1, 60, 3600, 86_400)) -> DataFrame:
    """Per event, the user's events in the last n seconds, itself included and an exact n seconds back left out."""
    out = events.withColumn("__at", micros(F.col(ts)))
    for n in seconds:
        frame = W.partitionBy(user).orderBy("__at").rangeBetween(-(n * 1_000_000 - 1), 0)
        out = out.withColumn(f"last_{n}s", F.count(F.lit(1)).over(frame))
    return out.drop("__at")


class Window:
    """Admitted times of one user within the last day, in microseconds."""

    def __init__(self, times=()):
        self.times = deque(times)

    def admit(self, at: int, limits: Limits) -> str | None:
        """None and the time is recorded, or the name of the limit that refuses it."""
        while self.times and at - self.times[0] >= 86_400_000_000:
            self.times.popleft()
        for seconds, most, name in limits.checks():
            # The k-th latest admitted time tells whether k lie inside the window.
            if most <= 0 or (len(self.times) >= most and at - self.times[-most] < seconds * 1_000_000):
                return name
        self.times.append(at)
        return None


def decisions(events: DataFrame, user: str, ts: str, order: str, limits: Limits = Limits()) -> DataFrame:
    """(user, order, admitted, stopped_by) per event.

    Only admitted events count against later ones, so each user's events are walked in time
    order (ties by `order`): one shuffle by user, a sort inside the partitions, and a pass
    that holds no more than the admitted times of one user's last day. Events without a user
    form one group; events without a time are refused ('no_time').
    """
    fields = f"`{user}` {events.schema[user].dataType.simpleString()}, `{order}` {events.schema[order].dataType.simpleString()}, admitted boolean, stopped_by string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, window = object(), Window()
        for batch in batches:
            stopped = []
            for who, at in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if who != current:
                    current, window = who, Window()
                stopped.append("no_time" if at is None else window.admit(at, limits))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s is None for s in stopped]), pa.array(stopped, pa.string())], names=[user, order, "admitted", "stopped_by"])

    timed = events.select(user, order, micros(F.col(ts)).alias("__at"))
    return timed.repartition(user).sortWithinPartitions(user, "__at", order).mapInArrow(run, fields)
