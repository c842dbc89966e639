"""The running score of a live feed: rows wait in state until the watermark has passed them, then come out in order."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

_LONG = lambda *names: StructType([StructField(n, LongType()) for n in names])

#: Milliseconds, the row's number, and whether it is a goal of either side.
_WAITING = ("at", "row_id", "home", "away")


class _Score(StatefulProcessor):
    """One game: the rows that wait, and the score of those that went. A timer stands at the earliest waiting row."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _LONG(*_WAITING))
        self.score = handle.getValueState("score", _LONG("home", "away"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            own = frame[frame["at"] >= done]  # what lies before the watermark is late: its order has gone out
            if len(own):
                self.waiting.appendList([tuple(map(int, r)) for r in own[list(_WAITING)].itertuples(index=False)])
                self.handle.registerTimer(int(own["at"].min()))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        done = timerValues.getCurrentWatermarkInMs()
        held = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        due, rest = [r for r in held if r[0] < done], [r for r in held if r[0] >= done]
        if not due:
            yield pd.DataFrame()
            return
        self.waiting.clear()
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0])
        home, away = self.score.get() if self.score.exists() else (0, 0)
        out = []
        for at, row_id, goal, other in due:
            home, away = home + goal, away + other
            out.append((*key, row_id, home, away))
        self.score.update((home, away))
        yield pd.DataFrame(out, columns=["game_id", "row_id", "home_score", "away_score"])

    def close(self) -> None:
        pass


def running_score(stream: DataFrame, game: str, at: str, row_id: str, home_goal: Column, away_goal: Column, late: str = "10 minutes") -> DataFrame:
    """game_id, row_id, home_score, away_score of each row, in the order of time and row_id within a game, however the rows
    arrive. A row goes out once the watermark (`late` behind the latest time) has passed it; one that comes after that is
    dropped. It must run within `timers`."""
    rows = stream.withWatermark(at, late).select(
        F.col(game).cast("long").alias("game_id"), F.col(at), F.floor(F.unix_micros(at) / 1000).cast("long").alias("at"), F.col(row_id).cast("long").alias("row_id"), home_goal.cast("long").alias("home"), away_goal.cast("long").alias("away")
    )
    return rows.groupBy("game_id").transformWithStateInPandas(_Score(), _LONG("game_id", "row_id", "home_score", "away_score"), "append", "EventTime")


@contextmanager
def timers(spark: SparkSession) -> Iterator[None]:
    """The state store that timers need, for streams that run within the block."""
    name, was = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, was)
