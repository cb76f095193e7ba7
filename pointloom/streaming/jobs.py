"""Structured Streaming forms: a running ledger, islands by session, a score kept for each match, first-of-a-burst."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.scoring import RULES, Match, State


def tail(spark: SparkSession, folder: str, columns: T.StructType, files: int = 1000) -> DataFrame:
    """Rows of JSON-lines files as they appear; a file counts once it stands there whole."""
    return spark.readStream.schema(columns).option("maxFilesPerTrigger", files).json(folder)


def running_totals(ledger: DataFrame, by: list[Column], values: list[str]) -> DataFrame:
    return ledger.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(v) for v in values])


def sessions(events: DataFrame, keys: list[str], ts: str, gap: str, late: str) -> DataFrame:
    """Runs of events with no pause longer than ``gap``, closed once the watermark has passed. The end is the last event's time."""
    window = F.session_window(ts, gap)
    out = events.withWatermark(ts, late).groupBy(*keys, window).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("start"), F.max(ts).alias("end"))
    return out.select(*keys, "n", "start", "end")


def within(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, reach: str, late: str) -> DataFrame:
    """Rows of ``left`` with each of ``right`` up to ``reach`` before them: an interval join of two streams."""
    a = left.withWatermark(left_ts, late).alias("a")
    b = right.withWatermark(right_ts, late).alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    on += [F.col(f"b.{right_ts}") <= F.col(f"a.{left_ts}"), F.col(f"b.{right_ts}") >= F.col(f"a.{left_ts}") - F.expr(f"interval {reach}")]
    return a.join(b, on)


def first_of_burst(events: DataFrame, keys: list[str], ts: str, apart: str) -> DataFrame:
    """Events without another of the same key up to ``apart`` before; which of a burst stays depends on arrival."""
    return events.withWatermark(ts, apart).dropDuplicatesWithinWatermark(keys)


_STATE = "next int, serves int, s1 int, s2 int, g1 int, g2 int, p1 int, p2 int, game int, swapped int, waiting array<struct<number:int,winner:int>>"
SCORES = "number int, winner int, set_no int, games_p1 int, games_p2 int, sets_p1 int, sets_p2 int, pts string, server int"


def live_scores(points: DataFrame, key: str, number: str, winner: str, first_server: int = 1, best_of: int = 3, regular: str = "seven", final: str = "seven") -> DataFrame:
    """The score before each point, as points arrive. Points of a match that come early wait for those before them; numbers
    start at 1. A missing winner ends a match."""
    match = Match(best_of, RULES[regular], RULES[final])
    kind = points.schema[key].dataType.simpleString()

    def update(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            nxt, serves, s1, s2, g1, g2, p1, p2, game, swapped, held = state.get
            now, waiting = State(serves, (s1, s2), (g1, g2), (p1, p2), game, swapped), {r[0]: r[1] for r in held or []}
        else:
            nxt, now, waiting = 1, State(first_server), {}
        for pdf in batches:
            waiting |= {int(n): None if pd.isna(w) else int(w) for n, w in zip(pdf[number], pdf[winner]) if int(n) >= nxt}
        rows = []
        while nxt in waiting:
            w = waiting.pop(nxt)
            d = match.describe(now)
            rows.append((group[0], nxt, w, d["set_no"], d["games_p1"], d["games_p2"], d["sets_p1"], d["sets_p2"], d["pts"], d["server"]))
            if w in (1, 2) and not match.over(now):
                now = match.after(now, w)
            nxt += 1
        state.update((nxt, now.serves, *now.sets, *now.games, *now.points, now.game, int(now.swapped), [(k, v) for k, v in waiting.items()]))
        out = pd.DataFrame(rows, columns=[key, "number", "winner", "set_no", "games_p1", "games_p2", "sets_p1", "sets_p2", "pts", "server"])
        yield out.astype({"winner": "Int32"}) if rows else out

    return points.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, {SCORES}", _STATE, "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is there now, through the stream into Parquet beside its checkpoint, read back. A complete result replaces the one
    before it; appended rows have a folder for each batch, so that a batch done twice leaves the same files."""
    rows, spark = f"{checkpoint}/rows-{name}", stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{rows}/batch-{0 if mode == 'complete' else number}")

    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{rows}/batch-none")
    query = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{checkpoint}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(rows)


def run_until(query: StreamingQuery, flag, every: float = 1.0) -> int:
    """Lets a query run until ``flag()`` is true, then ends it after the batch under way; the number of its last batch."""
    while query.isActive and not flag():
        query.awaitTermination(every)
    while query.isActive and query.status["isTriggerActive"]:
        query.awaitTermination(0.1)
    last = query.lastProgress
    query.stop()
    return last["batchId"] if last else -1


def each_batch(stream: DataFrame, path: str, keys: list[str], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Writes batches so that a batch done twice leaves the same files: a batch's folder is replaced by its number."""

    def put(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(keys).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
