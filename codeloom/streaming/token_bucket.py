"""A token-bucket limiter as a stateful stream: one bucket per client, kept between micro-batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..sources.store import shared_dir

OUT, STATE = "client string, request long, admitted boolean", "tokens double, last double"


def admit(times: Iterable[float], rate: float, burst: float, tokens: float, last: float | None) -> tuple[list[bool], float, float | None]:
    """Whether each request (seconds, ascending) takes a token, and the bucket afterwards. `rate` tokens a second flow in, up to
    `burst`; a request earlier than the last one adds none."""
    out = []
    for at in times:
        tokens = min(burst, tokens + max(0.0, at - last) * rate) if last is not None else tokens
        last = at if last is None else max(last, at)
        out.append(tokens >= 1)
        tokens -= out[-1]
    return out, tokens, last


def limit(requests: DataFrame, rate: float, burst: float) -> DataFrame:
    """`requests` (client, request, at in seconds), a stream, with `admitted`. Of one micro-batch, requests count in order of
    (at, request); a client's part of it must fit in memory, which maxFilesPerTrigger or its like bounds."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["at", "request"])
        tokens, last = state.get if state.exists else (burst, None)
        admitted, tokens, last = admit(rows["at"].tolist(), rate, burst, tokens, last)
        state.update((tokens, last))
        yield pd.DataFrame({"client": key[0], "request": rows["request"].to_numpy(), "admitted": admitted})

    return requests.groupBy("client").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def run_on_files(spark: SparkSession, path: str, schema, rate: float, burst: float) -> DataFrame:
    """All event files of a path (event_id, ts, user_id; a glob for a single file) through the limiter, one trigger after the other, as a table."""
    to = f"{shared_dir(spark)}/codeloom/bucket-{uuid.uuid4().hex}"
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path)
    requests = events.select(F.col("user_id").cast("string").alias("client"), F.col("event_id").cast("long").alias("request"), F.col("ts").cast("timestamp").cast("double").alias("at"))
    stream = limit(requests, rate, burst).writeStream.format("parquet").option("path", f"{to}/out").option("checkpointLocation", f"{to}/state").trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.schema(OUT).parquet(f"{to}/out")


# --- with timers --------------------------------------------------------------------------------------------------


class _Bucket(StatefulProcessor):
    """A client's bucket, and a timer for when it is full again: from then on it is as good as none, and its state goes."""

    def __init__(self, rate: float, burst: float):
        self.rate, self.burst = rate, burst

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows))
        batch["at"] = batch["time"].astype("datetime64[ns]").astype("int64") / 1e9
        batch = batch.sort_values(["at", "request"])
        tokens, last = self.bucket.get() if self.bucket.exists() else (self.burst, None)
        admitted, tokens, last = admit(batch["at"].tolist(), self.rate, self.burst, tokens, last)
        self.bucket.update((tokens, last))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        full = int(1000 * (last + (self.burst - tokens) / self.rate)) + 1
        self.handle.registerTimer(max(full, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({"client": key[0], "request": batch["request"].to_numpy(), "admitted": admitted})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.bucket.clear()
        yield pd.DataFrame({"client": pd.Series(dtype=str), "request": pd.Series(dtype="int64"), "admitted": pd.Series(dtype=bool)})

    def close(self) -> None:
        """Nothing is open."""


def limit_with_timers(requests: DataFrame, rate: float, burst: float, delay: str = "1 second") -> DataFrame:
    """As limit(), of `requests` (client, request, time as a timestamp), with the same decisions; but the state of a client goes
    once the stream's time (the latest request less `delay`) has passed the moment when its bucket is full again, so idle clients
    cost nothing. Requests that are later than `delay` behind the stream are dropped. Needs the RocksDB state store."""
    timed = requests.withWatermark("time", delay).select("client", "request", "time")
    return timed.groupBy("client").transformWithStateInPandas(_Bucket(rate, burst), OUT, "Append", "EventTime")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_with_timers(spark: SparkSession, path: str, schema, rate: float, burst: float, to: str | None = None, files: int = 8, delay: str = "1 second") -> tuple[DataFrame, list[int]]:
    """All event files of a path that a run into the same folder has not seen, and the rows of state after each batch."""
    to = to or f"{shared_dir(spark)}/codeloom/bucket-{uuid.uuid4().hex}"
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    requests = events.select(F.col("user_id").cast("string").alias("client"), F.col("event_id").cast("long").alias("request"), F.col("ts").cast("timestamp").alias("time"))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    try:
        stream = limit_with_timers(requests, rate, burst, delay).writeStream.format("parquet").option("path", f"{to}/out").option("checkpointLocation", f"{to}/state").trigger(availableNow=True).start()
        stream.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(OUT).parquet(f"{to}/out"), [p.stateOperators[0].numRowsTotal for p in stream.recentProgress if p.stateOperators]
