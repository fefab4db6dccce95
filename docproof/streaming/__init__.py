"""The batch queue as a stream: items settle one by one, a failed one stops no other, and only those that need it run again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Items that are worked on at a time.
CONCURRENCY = 2
SETTLED = "item_id string, status string, value string, error string"


def settle(items: DataFrame, worker: Callable[[str], str], concurrency: int = CONCURRENCY, stopped: Callable[[], bool] | None = None) -> DataFrame:
    """(item_id, status, value, error) of items(item_id, payload): fulfilled, rejected with the error's type, or skipped once ``stopped`` holds. At most ``concurrency`` items run at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for item, payload in zip(batch["item_id"], batch["payload"]):
                if stopped is not None and stopped():
                    out.append((item, "skipped", None, None))
                    continue
                try:
                    out.append((item, "fulfilled", worker(payload), None))
                except Exception as error:  # noqa: BLE001, an item's failure is its result; its text may hold submitted values
                    out.append((item, "rejected", None, type(error).__name__))
            yield pd.DataFrame(out, columns=["item_id", "status", "value", "error"])

    return items.select(F.col("item_id").cast("string").alias("item_id"), F.col("payload").cast("string").alias("payload")).coalesce(concurrency).mapInPandas(run, SETTLED)


def start(items: DataFrame, worker: Callable[[str], str], path: str, checkpoint: str, concurrency: int = CONCURRENCY) -> StreamingQuery:
    """Settle a stream of items and append the results to ``path``; a restarted query goes on where it was."""
    return settle(items, worker, concurrency).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def latest(states: DataFrame) -> DataFrame:
    """The last state of each item of states(item_id, at, status, ...)."""
    last = Window.partitionBy("item_id").orderBy(F.desc("at"), F.desc("status"))
    return states.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


def to_run(states: DataFrame, retry: bool = False) -> DataFrame:
    """The items to start: ready or cancelled ones; with ``retry`` only those that failed."""
    return latest(states).where(F.col("status") == "error" if retry else F.col("status").isin("ready", "cancelled"))


#: Which states may follow a state; others are final.
FOLLOWS = {None: ("ready", "invalid"), "ready": ("processing", "cancelled"), "cancelled": ("processing",), "processing": ("match", "review", "mismatch", "error", "cancelled"), "error": ("processing",)}
STATE = "item_id string, position bigint, status string, at bigint, attempts int, refused int"
#: The closed set of error codes, by type of the error; any other is "processing".
CODES = {"TimeoutError": "timeout", "ConnectionError": "unavailable", "ConnectionRefusedError": "unavailable", "ConnectionResetError": "unavailable", "OSError": "unavailable"}


def track(events: DataFrame) -> DataFrame:
    """The state of each item, kept by key, from a stream of events(item_id, position, status, at): a row of ``STATE`` whenever it has changed.

    Events of a batch are taken in order of (at, status); one that may not follow the item's state changes nothing and
    is counted. attempts counts the times that an item was started. A restarted stream goes on from the kept states.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        position, status, at, attempts, refused = state.get if state.exists else (None, None, None, 0, 0)
        before = (status, attempts, refused)
        rows = sorted((int(a), s, p) for b in batches for a, s, p in zip(b["at"], b["status"], b["position"]))
        for when, new, place in rows:
            if new in FOLLOWS.get(status, ()):
                status, at, attempts = new, when, attempts + (new == "processing")
                position = int(place) if position is None and place == place and place is not None else position
            else:
                refused += 1
        state.update((position, status, at, attempts, refused))
        if before != (status, attempts, refused):
            yield pd.DataFrame([(key[0], position, status, at, attempts, refused)], columns=["item_id", "position", "status", "at", "attempts", "refused"]).astype({"position": "Int64", "at": "Int64"})

    keyed = events.select(F.col("item_id").cast("string").alias("item_id"), F.col("position").cast("bigint").alias("position"), "status", F.col("at").cast("bigint").alias("at"))
    kept = STATE.split(", ", 1)[1]
    return keyed.groupBy("item_id").applyInPandasWithState(update, STATE, kept, "update", GroupStateTimeout.NoTimeout)


def in_order(items: DataFrame, results: DataFrame) -> DataFrame:
    """A row for each of items(position, item_id), by position: its result, or skipped where there is none."""
    met = items.join(results.drop("position") if "position" in results.columns else results, "item_id", "left")
    return met.withColumn("status", F.coalesce("status", F.lit("skipped"))).orderBy("position")


def start_queue(items: DataFrame, worker: Callable[[str], str], path: str, checkpoint: str, stop: Callable[[], bool] | None = None, concurrency: int = CONCURRENCY) -> StreamingQuery:
    """Settle a stream of items into ``path``, under batch=<id>/outcome=good, failed or skipped.

    Each micro-batch replaces its own folder, so a batch that runs again doubles nothing. Failed rows have an error code
    of ``CODES`` or "processing" and never a value or a message, which may hold what was submitted. ``stop`` is asked on
    the driver before each batch (for example whether a table of stop signals has rows): from then on items are skipped,
    without a call of the worker. At most ``concurrency`` items, in as many tasks, run at a time, whatever the batch's size.
    """
    codes = F.create_map(*(F.lit(x) for pair in CODES.items() for x in pair))

    def write(batch: DataFrame, number: int) -> None:
        if stop is not None and stop():
            done = batch.select(F.col("item_id").cast("string").alias("item_id"), F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("error"))
        else:
            done = settle(batch, worker, concurrency)
        code = F.when(F.col("status") == "rejected", F.coalesce(F.try_element_at(codes, F.col("error")), F.lit("processing")))
        outcome = F.when(F.col("status") == "rejected", "failed").when(F.col("status") == "skipped", "skipped").otherwise("good")
        done.withColumns({"error": code, "outcome": outcome}).write.mode("overwrite").partitionBy("outcome").parquet(f"{path}/batch={number}")

    return items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def settled(spark: SparkSession, path: str) -> DataFrame:
    """What ``start_queue`` has written so far: item_id, status, value, error, batch, outcome."""
    return spark.read.option("basePath", path).schema(f"{SETTLED}, batch bigint, outcome string").parquet(f"{path}/batch=*")
