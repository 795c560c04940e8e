"""Small bins over a stream: reads wait in state until their bin is large enough."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructField, StructType

from ..functions.dna import K
from ..operators.bins import as_n

#: The state store that list state needs: a value of spark.sql.streaming.stateStore.providerClass.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SmallBins(StatefulProcessor):
    """Reads of a bin are held, fewer than ``least`` of them, until the bin has ``least``; then all go on, and later ones at once.

    With ``idle_ms``, reads that have waited so long since the last one came
    go on with to_n set, and the bin starts anew.
    """

    def __init__(self, schema: StructType, least: int, idle_ms: int | None, k: int):
        self.schema, self.least, self.idle_ms, self.n = schema, least, idle_ms, 4**k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "is_open boolean")
        self.held = handle.getListState("held", self.schema)

    def _frame(self, rows, to_n: bool) -> pd.DataFrame:
        return pd.DataFrame([tuple(r) for r in rows], columns=self.schema.names).assign(to_n=to_n)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        is_open = key[0] == self.n or self.open.exists()
        held: list[tuple] = []
        came = False
        for f in rows:
            f = f[self.schema.names]
            came |= len(f) > 0
            if not is_open:
                held = held or (list(map(tuple, self.held.get())) if self.held.exists() else [])
                held += f.itertuples(index=False, name=None)
                if len(held) < self.least:
                    continue
                is_open = True
                self.open.update((True,))
                self.held.clear()
                yield self._frame(held, False)
            else:
                yield f.assign(to_n=False)
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t if isinstance(t, int) else t[0])
        if not is_open and held:
            self.held.put(held)
            if self.idle_ms is not None and came:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            rows = list(map(tuple, self.held.get()))
            self.held.clear()
            yield self._frame(rows, True)

    def close(self) -> None:
        pass


def large_bins_stream(binned: DataFrame, least: int = 8, idle_ms: int | None = None, k: int = K) -> DataFrame:
    """Streaming binned reads, of bins once they hold ``least`` reads, and with to_n set those that waited for ``idle_ms``.

    State holds fewer than ``least`` reads for each of at most 4^k bins. The
    session's state store must be PROVIDER. What still waits when a query has
    ended is given by ``waiting``: these and the query's rows are, for bins
    over all data, those of ``bins.small_to_n``.
    """
    schema = binned.schema
    out = StructType([*schema.fields, StructField("to_n", BooleanType())])
    processor = SmallBins(schema, least, idle_ms, k)
    return binned.groupBy("signature").transformWithStateInPandas(processor, out, "Append", "None" if idle_ms is None else "ProcessingTime")


def waiting(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The reads that an ended query of ``large_bins_stream`` still holds."""
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "held").option("flattenCollectionTypes", True).load()
    return held.select("list_element.*")


def settled(rows: DataFrame, still: DataFrame | None = None, k: int = K) -> DataFrame:
    """Binned reads from the query's rows (to_n undone and moved to the N bin) and those that still waited."""
    out = rows.where("not to_n").drop("to_n").unionByName(as_n(rows.where("to_n").drop("to_n"), k))
    return out if still is None else out.unionByName(as_n(still, k))
