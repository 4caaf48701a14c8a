"""Streams whose rows are worked off in order by a small step function, on ``transformWithState``.

A step sees a stream's state (a tuple, or None at first), its new rows in the order of ``seq``, and gives the
new state (None: forgotten) and result rows. The state is one value a stream in RocksDB; it goes when the
stream has been idle for IDLE_MS of processing time (a time to live, so no timer is needed). There is no event
time, so there is no watermark. State can be looked at with ``states``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..session import attach

IDLE_MS = 600_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
Step = Callable[[str, tuple | None, Iterator], tuple[tuple | None, list[tuple]]]


class Steps(StatefulProcessor):
    def __init__(self, step: Step, state: str, columns: list[str], idle_ms: int):
        self.step, self.schema, self.columns, self.idle_ms = step, state, columns, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.schema, self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = tuple(self.state.get()) if self.state.exists() else None
        new, out = self.step(key[0], held, pd.concat(list(rows)).sort_values("seq").itertuples())
        if new is not None:
            self.state.update(tuple(new))
        elif held is not None:
            self.state.clear()
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def stepped(rows: DataFrame, step: Step, state: str, result: str, idle_ms: int = IDLE_MS) -> DataFrame:
    """``result`` rows of a stream of (stream_id, seq, ...)."""
    spark = attach(rows.sparkSession)
    if spark.conf.get(PROVIDER) != ROCKSDB:
        spark.conf.set(PROVIDER, ROCKSDB)  # what transformWithState is built on
    keyed = rows.withColumns({"stream_id": F.col("stream_id").cast("string"), "seq": F.col("seq").cast("long")})
    columns = [c.strip().split(" ")[0] for c in result.split(",")]
    return keyed.groupBy("stream_id").transformWithStateInPandas(Steps(step, state, columns, idle_ms), outputStructType=result, outputMode="Append", timeMode="ProcessingTime")


def states(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(stream_id, state, expires) of the streams that a query's checkpoint holds."""
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "state").load()
    return held.select(F.col("key.stream_id").alias("stream_id"), F.col("value.value").alias("state"), F.timestamp_millis("value.ttlExpirationMs").alias("expires"))
