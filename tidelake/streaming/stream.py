"""Structured Streaming forms: a recording query with an idempotent sink, and a stateful throttle."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidelake.plans.config import Config
from tidelake.sinks.roll import append_batch
from tidelake.sources.files import Store
from tidelake.streaming.ingest import BUS, STATE, record_on


def read_bus(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """SRC-8, STR-8: JSON lines from a folder; micro-batches are bounded by files."""
    return spark.readStream.schema(BUS).option("maxFilesPerTrigger", files_per_batch).json(folder)


def record_stream(bus: DataFrame, store: Store, config: Config, self_context: str, checkpoint: str, trigger: dict | None = None):
    """SNK-1, STR-10: each micro-batch goes through the chain and into ``hot/batch=<id>`` once; offsets and batch ids come from the
    checkpoint, so a batch that is run again after a crash is skipped. Late rows are never dropped.

    STR-4, STR-6, STR-7: slots, last kept times and names go from batch to batch by tables ``state/batch=<id>``. A batch reads the
    newest one before its own and writes its own before its rows, so that it can be run again at any point."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [n for n in store.names("state") if n.startswith("batch=") and int(n[6:]) < batch_id]
        state = spark.read.schema(STATE).parquet(store.at("state", before[-1])) if before else None
        batch = batch.persist()
        try:
            samples, after = record_on(batch, config, self_context, state)
            name = f"batch={batch_id:012d}"
            after.write.mode("overwrite").parquet(store.at("state", f"_{name}"))
            store.rename(f"state/_{name}", f"state/{name}")
            append_batch(store, samples.drop("rowid"), batch_id)
        finally:
            batch.unpersist()
        for old in before[:-1]:
            store.delete("state", old)

    return bus.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def throttle_stream(rows: DataFrame, schema: str) -> DataFrame:
    """STR-4 on a stream: the state of a (path, context) is the time of its last kept row; the caps bound how many there are.

    ``rows`` have path, context, recv_ts, seq and rate; ``schema`` is theirs."""

    def keep(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for part in parts:
            part = part.sort_values("seq")
            kept = []
            for now, least in zip(part["recv_ts"], part["rate"], strict=True):
                ok = last is None or not 0 <= now - last < least
                last = int(now) if ok else last
                kept.append(ok)
            yield part[kept]
        if last is not None:
            state.update((last,))

    return rows.groupBy("path", "context").applyInPandasWithState(keep, schema, "ts long", "append", GroupStateTimeout.NoTimeout)


def windowed_average(samples: DataFrame, width_ms: int, delay: str = "10 minutes") -> DataFrame:
    """Tumbling averages of a stream of samples, final when the watermark passes; the same buckets as batch answers."""
    stamped = samples.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", delay)
    return stamped.groupBy(F.window("at", f"{width_ms} milliseconds").alias("w"), "context", "path").agg(F.avg("value_num").alias("num")).select(F.unix_millis("w.start").alias("bucket"), "context", "path", "num")

