"""Running latest complete capture per scope as keyed stream state with event-time timers.

A scope's state is the number of rows of each open capture and the best closed one. A capture closes when the watermark
passes its time by the lateness of the stream; the timer then folds it into the best and forgets it, so the state of a scope is
bounded by the captures of one lateness.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# the processor travels to the executors by value, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Captures(StatefulProcessor):
    """Rows (scope, captured) to the newest capture among the largest, each time a scope has rows or closes a capture."""

    def __init__(self, captured: str):
        self.captured = captured

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "millis long", "n long")
        self.best = handle.getValueState("best", "n long, millis long")

    def close_passed(self, watermark: int) -> None:
        """Fold captures that no row can reach any more into the best."""
        for (millis,), (n,) in list(self.open.iterator()):
            if millis < watermark:
                self.best.update(max((n, millis), self.best.get() if self.best.exists() else (-1, -1)))
                self.open.removeKey((millis,))

    def now(self, key: Any) -> pd.DataFrame:
        found = [(n, millis) for (millis,), (n,) in self.open.iterator()]
        n, millis = max([*found, tuple(self.best.get())] if self.best.exists() else found)
        return pd.DataFrame([[*key, n, pd.Timestamp(millis, unit="ms")]])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - names of the interface
        for pdf in rows:
            for at, n in pdf[self.captured].value_counts().items():
                millis = int(at.value // 1_000_000)
                before = self.open.getValue((millis,))[0] if self.open.containsKey((millis,)) else 0
                self.open.updateValue((millis,), (before + int(n),))
                self.handle.registerTimer(millis + 1)
        yield self.now(key)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - names of the interface
        self.close_passed(timerValues.getCurrentWatermarkInMs())
        yield self.now(key)

    def close(self) -> None:
        pass


def latest_complete_stream(feed: DataFrame, scope: Sequence[str], captured: str, lateness: str, size: str = "n") -> DataFrame:
    """(scope, size, captured) in update mode; the newest row of a scope is its latest complete capture so far.

    Rows that are later than ``lateness`` behind the newest capture are too late to count. Needs the RocksDB state store.
    """
    fields = [feed.schema[c] for c in scope]
    schema = T.StructType([*fields, T.StructField(size, T.LongType()), T.StructField(captured, T.TimestampType())])
    rows = feed.select(*scope, captured).withWatermark(captured, lateness)
    return rows.groupBy(*scope).transformWithStateInPandas(Captures(captured), schema, "Update", "EventTime")


class rocksdb_state:  # noqa: N801 - used as a function
    """Streams started inside keep their state in RocksDB; the session's setting is put back afterwards."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(PROVIDER, None)
        self.spark.conf.set(PROVIDER, ROCKSDB)

    def __exit__(self, *_: object) -> None:
        if self.before is None:
            self.spark.conf.unset(PROVIDER)
        else:
            self.spark.conf.set(PROVIDER, self.before)
