"""Structured Streaming: score a stream against a fitted distribution, keep its best rows, fold state machines."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gleaner.operators import profile, surprise
from gleaner.operators.ranking import top_k
from gleaner.plans.scratch import shared_folder
from gleaner.session import ship


def scored(stream: DataFrame, col: str, fitted: DataFrame) -> DataFrame:
    """The stream with its surprise; a projection against one broadcast row."""
    return surprise.score(stream, col, fitted)


class BestOf:
    """A foreachBatch sink that keeps the k best rows seen so far, as a table in the shared folder.

    A batch is merged with the table of the last one; a batch that runs again replaces its own table.
    """

    def __init__(self, stream: DataFrame, score: str, k: int, id_col: str, name: str):
        self.score, self.k, self.id_col, self.schema = score, k, id_col, stream.schema
        self.folder = f"{shared_folder(stream.sparkSession)}/{name}"
        self.last = -1

    def __call__(self, batch: DataFrame, number: int) -> None:
        rows = batch
        if self.last >= 0 and self.last != number:
            rows = rows.unionByName(self.table(batch.sparkSession))
        top_k(rows, self.score, self.k, self.id_col).write.mode("overwrite").parquet(f"{self.folder}/{number}")
        self.last = number

    def table(self, spark) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.folder}/{self.last}")


def run_once(stream: DataFrame, sink, checkpoint: str) -> StreamingQuery:
    """Process all that is there through a foreachBatch sink, then stop."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


class Fitting:
    """A foreachBatch sink for the first pass over a stream: counts of different values, as tables of batches.

    A batch that runs again replaces its own table; the fit adds all tables, so order and repetition don't matter.
    """

    def __init__(self, spark: SparkSession, col: str, name: str):
        self.spark, self.col, self.folder, self.batches = spark, col, f"{shared_folder(spark)}/{name}", set()

    def __call__(self, batch: DataFrame, number: int) -> None:
        batch.groupBy(surprise.scalar(batch, self.col).alias("x")).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{self.folder}/{number}")
        self.batches.add(number)

    def fitted(self) -> DataFrame:
        """The distribution of all that was seen, as surprise.fit gives it for a table."""
        counts = self.spark.read.schema("x double, n long").parquet(*[f"{self.folder}/{b}" for b in sorted(self.batches)])
        return surprise.fit_counts(counts, "x", "n")


def fit_stream(stream: DataFrame, col: str, checkpoint: str) -> DataFrame:
    """The first pass: process all that is there and fit it."""
    sink = Fitting(stream.sparkSession, col, f"fit-{uuid.uuid4().hex}")
    run_once(stream, sink, checkpoint)
    return sink.fitted()


def run_stream(stream: DataFrame, col: str, fitted: DataFrame, k: int, checkpoint: str, *, id_col: str = "id", threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """The second pass: the k most surprising rows of a stream, with tiers, and the tiers' counts."""
    live = scored(stream, col, fitted)
    sink = BestOf(live, "surprise", k, id_col, f"best-{uuid.uuid4().hex}")
    run_once(live, sink, checkpoint)
    rows = profile.tiers(sink.table(stream.sparkSession), "surprise", threshold)
    return rows, rows.groupBy("tier").agg(F.count("*").alias("n"))


def heartbeats(ticks: DataFrame, *, leak: float = 1.0) -> DataFrame:
    """(daemon, seq, state) for a stream or table of ticks (daemon, seq, dt, signal array): every tick moves a
    daemon's state one step towards its input."""
    ship(ticks.sparkSession)
    schema = "daemon string, seq long, state array<double>"

    def rows_of(daemon: str, rows: pd.DataFrame, state: list[float] | None) -> tuple[pd.DataFrame, list[float]]:
        out = []
        for seq, dt, signal in rows.sort_values("seq")[["seq", "dt", "signal"]].itertuples(index=False):
            state = heartbeat_step(state or [0.0] * len(signal), list(signal), dt, leak=leak)
            out.append((daemon, seq, state))
        return pd.DataFrame(out, columns=["daemon", "seq", "state"]), state

    if not ticks.isStreaming:
        return ticks.groupBy("daemon").applyInPandas(lambda key, rows: rows_of(key[0], rows, None)[0], schema)

    def run(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        out, state = rows_of(key[0], pd.concat(parts), list(held.get[0]) if held.exists else None)
        held.update((state,))
        yield out

    return ticks.groupBy("daemon").applyInPandasWithState(run, schema, "state array<double>", "append", GroupStateTimeout.NoTimeout)


def windowed_means(stream: DataFrame, ts: str, x: str, *, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An extension: means over windows of event time, closed by a watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, length)).agg(F.avg(x).alias("mean"), F.count("*").alias("n"))


def breaker_step(state: tuple[str, int, float], at: float, ok: bool, *, limit: int = 3, cooldown: float = 30.0) -> tuple[tuple[str, int, float], bool]:
    """A circuit breaker's next state (name, failures in a row, when it opened) for one request's outcome, and
    whether the request was let through."""
    name, failures, opened = state
    if name == "open":
        if at - opened < cooldown:
            return state, False
        name = "half_open"
    if ok:
        return ("closed", 0, 0.0), True
    if name == "half_open" or failures + 1 >= limit:
        return ("open", failures + 1, at), True
    return ("closed", failures + 1, 0.0), True


def breaker(requests: DataFrame, *, limit: int = 3, cooldown: float = 30.0) -> DataFrame:
    """(service, seq, allowed, state) for a stream or table of requests (service, seq, at double, ok)."""
    ship(requests.sparkSession)

    def rows_of(service: str, rows: pd.DataFrame, state: tuple) -> tuple[pd.DataFrame, tuple]:
        out = []
        for seq, at, ok in rows.sort_values("seq")[["seq", "at", "ok"]].itertuples(index=False):
            state, allowed = breaker_step(state, at, ok, limit=limit, cooldown=cooldown)
            out.append((service, seq, allowed, state[0]))
        return pd.DataFrame(out, columns=["service", "seq", "allowed", "state"]), state

    schema = "service string, seq long, allowed boolean, state string"
    if not requests.isStreaming:
        return requests.groupBy("service").applyInPandas(lambda key, rows: rows_of(key[0], rows, ("closed", 0, 0.0))[0], schema)

    def run(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = held.get if held.exists else ("closed", 0, 0.0)
        out, state = rows_of(key[0], pd.concat(parts), state)
        held.update(state)
        yield out

    return requests.groupBy("service").applyInPandasWithState(run, schema, "state string, failures int, opened double", "append", GroupStateTimeout.NoTimeout)


def heartbeat_step(state: list[float], signal: list[float], dt: float, *, leak: float = 1.0) -> list[float]:
    """One step of a leaky state towards its input, cut to +-10."""
    return [max(-10.0, min(10.0, s + dt * (x - s / leak))) for s, x in zip(state, signal, strict=True)]
