"""The annotated corpus as a stream.

Row-wise operators run on it unchanged; those that group, join or sort run on its batches (`publish_tagged`).
"""

from __future__ import annotations

import heapq
import threading
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tagweave import schemas
from tagweave.plans.annotate import Tagger
from tagweave.sources import publish_batch, settled, with_annotations


def stream_annotated(spark: SparkSession, path: str, schema: str = schemas.V2, files_per_trigger: int | None = None) -> DataFrame:
    """JSON-lines files as they arrive in a directory."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    df = reader.json(path)
    return with_annotations(df) if schema == schemas.V2 else df


def stream_columnar(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def publish(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to Parquet files, exactly once, and stop."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish_counts(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Rewrite the totals of an aggregated stream after every batch, and stop at the end of what has arrived."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish_tagged(df: DataFrame, tagger: Tagger, path: str, checkpoint: str) -> StreamingQuery:
    """Tag what has arrived, batch by batch, and stop; `sources.read_batches` reads the result.

    tagger may group, join and sort, as it gets each batch whole. A batch goes into a log once its files are
    there, so that one that runs again after a restart is published once.
    """

    def write(batch: DataFrame, number: int) -> None:
        publish_batch(tagger(batch), path, number)

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class HeadCounter(StatefulProcessor):
    """Counts keys of the first n rows of a stream, and nothing after them."""

    def __init__(self, n: int) -> None:
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long")
        self.counts = handle.getMapState("counts", "key string", "n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        seen = self.seen.get()[0] if self.seen.exists() else 0
        if seen >= self.n:
            return
        head = heapq.nsmallest(self.n - seen, ((r["place"], r["keys"]) for r in rows))
        for _, keys in head:
            for k in keys or ():
                self.counts.updateValue((k,), ((self.counts.getValue((k,))[0] if self.counts.containsKey((k,)) else 0) + 1,))
        seen += len(head)
        self.seen.update((seen,))
        for (k,), (n,) in self.counts.iterator():
            yield Row(key=k, n=n, seen=seen)

    def close(self) -> None:
        pass


def _head_of_part(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            both = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            held = both.sort_by("place").slice(0, n)
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return run


def publish_head_counts(df: DataFrame, keys: str, n: int, order_by: str, path: str, checkpoint: str) -> StreamingQuery:
    """(key, n): in how many of a stream's first n rows each of an array's keys is; the stream stops after them.

    Batches come one after another, rows of a batch in the order of a unique long column. What is counted
    is state, so a restart goes on counting. At most n rows of a task travel.
    """
    spark = df.sparkSession
    rows = df.select(F.lit(0).alias("all"), F.col(order_by).cast("long").alias("place"), F.array_distinct(F.col(keys).cast("array<string>")).alias("keys"))
    rows = rows.mapInArrow(_head_of_part(n), rows.schema)
    conf, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(conf)
    counts = rows.groupBy("all").transformWithState(HeadCounter(n), "key string, n long, seen long", "Update", "None")
    started: list[StreamingQuery] = []
    ready = threading.Event()

    def write(batch: DataFrame, _: int) -> None:
        totals = settled(batch)
        seen = totals.agg(F.max("seen")).first()[0]
        if seen is None:
            return
        totals.select("key", "n").write.mode("overwrite").parquet(path)
        if seen >= n:  # a query can't wait for itself to stop
            threading.Thread(target=lambda: (ready.wait(), started[0].stop()), daemon=True).start()

    spark.conf.set(conf, provider)
    try:
        query = counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(conf, before)
    started.append(query)
    ready.set()
    return query
