"""Structured Streaming: windows, de-duplication, medallion, rate limits and the keyed cache."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from millrace.operators.infer import Infer, echo_stub, with_answers
from millrace.operators.ratelimit import Limits, Window, micros
from millrace.session import as_instant, ensure_checkpoint_dir

DELAY = "10 minutes"


def answered(stream: DataFrame, prompt: str, out: str = "ai_response", infer: Infer = echo_stub) -> DataFrame:
    """A stateless map: adds the model's answer to each row."""
    return with_answers(stream, prompt, out, infer)


def tumbling(rows: DataFrame, ts: str, width: str, by: list[str], delay: str = DELAY) -> DataFrame:
    """Counts and sums of `value` per window and key; late rows beyond the watermark are dropped on a stream."""
    rows = as_instant(rows, ts)
    rows = rows.withWatermark(ts, delay) if rows.isStreaming else rows
    found = rows.groupBy(F.window(ts, width), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("window.start").alias("window_start"), *by, "n", "total")


def sliding(rows: DataFrame, ts: str, width: str, slide: str, by: list[str], delay: str = DELAY) -> DataFrame:
    rows = as_instant(rows, ts)
    rows = rows.withWatermark(ts, delay) if rows.isStreaming else rows
    return rows.groupBy(F.window(ts, width, slide), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), *by, "n")


def sessions(rows: DataFrame, ts: str, gap: str, by: list[str], delay: str = DELAY) -> DataFrame:
    """Sessions per key, ended by a gap."""
    rows = as_instant(rows, ts)
    rows = rows.withWatermark(ts, delay) if rows.isStreaming else rows
    found = rows.groupBy(F.session_window(ts, gap), *by).agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *by, "n")


def deduplicated(stream: DataFrame, key: list[str], ts: str, delay: str = DELAY) -> DataFrame:
    return as_instant(stream, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)


def _timed(stream: DataFrame, names: list[str], ts: str, delay: str) -> DataFrame:
    rows = as_instant(stream.filter(F.col(ts).isNotNull()), ts).withWatermark(ts, delay)
    return rows.select(*names, ts, micros(F.col(ts)).alias("__at"))


def _expire(state, at_ms: int) -> None:
    state.setTimeoutTimestamp(max(at_ms, state.getCurrentWatermarkMs() + 1))


def limits(stream: DataFrame, user: str, ts: str, order: str, allowed: Limits = Limits(), delay: str = DELAY) -> DataFrame:
    """(user, order, admitted, stopped_by) per event of a stream, by the same rule as the batch.

    State per user: the admitted times of the last day, dropped once the watermark is a day
    past the user's last event. Within a micro-batch events are taken in time order; an event older than one already
    decided is judged with what is known then.
    """
    fields = f"`{user}` {stream.schema[user].dataType.simpleString()}, `{order}` {stream.schema[order].dataType.simpleString()}, admitted boolean, stopped_by string"

    def judge(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        window = Window(state.get[0] if state.exists else ())
        events = pd.concat(list(frames)).sort_values(["__at", order])
        stopped = [window.admit(int(at), allowed) for at in events["__at"]]
        state.update((list(window.times),))
        _expire(state, int(events["__at"].max()) // 1000 + 86_400_000)
        yield pd.DataFrame({user: key[0], order: events[order].to_numpy(), "admitted": [s is None for s in stopped], "stopped_by": stopped})

    return _timed(stream, [user, order], ts, delay).groupBy(user).applyInPandasWithState(judge, fields, "times array<bigint>", "append", "EventTimeTimeout")


def cached(stream: DataFrame, key: str, ts: str, order: str, ttl_seconds: float, delay: str = DELAY) -> DataFrame:
    """(key, order, hit): a keyed cache with a time to live; a hit does not prolong it."""
    ttl = int(ttl_seconds * 1_000_000)
    fields = f"`{key}` {stream.schema[key].dataType.simpleString()}, `{order}` {stream.schema[order].dataType.simpleString()}, hit boolean"

    def serve(who: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        since = state.get[0] if state.exists else None
        events, hits = pd.concat(list(frames)).sort_values(["__at", order]), []
        for at in events["__at"]:
            hit = since is not None and (ttl <= 0 or at - since <= ttl)
            since = since if hit else int(at)
            hits.append(hit)
        state.update((since,))
        if ttl > 0:
            _expire(state, (since + ttl) // 1000 + 1)
        yield pd.DataFrame({key: who[0], order: events[order].to_numpy(), "hit": hits})

    return _timed(stream, [key, order], ts, delay).groupBy(key).applyInPandasWithState(serve, fields, "since bigint", "append", "EventTimeTimeout")


def upsert_each(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs `write(batch, number)` per micro-batch; with `once` over what is there now."""
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def append_to(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends a stream to a parquet folder, exactly once per input row."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def run_now(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives for the rows that are there now, as a table in the shared folder; `complete` for aggregates without their open windows left out."""
    folder = f"{ensure_checkpoint_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/out")

    stream.sparkSession.createDataFrame([], stream.schema).write.parquet(f"{folder}/out")
    writer = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
