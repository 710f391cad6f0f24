"""Searches and log records that arrive as streams, and searches that wait for each other."""

from __future__ import annotations

import threading
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellate.functions.metrics import InvalidArgument
from stellate.sources.store import sealed


def search_stream(queries: DataFrame, search, out: str, checkpoint: str, **trigger):
    """A streaming query that writes search(batch) of every batch of streamed queries to `out`.

    Each batch goes to a folder named by its number, overwritten if the batch is run again, so
    results hold every query once. `trigger` as for writeStream.trigger."""

    def run(batch: DataFrame, number: int) -> None:
        search(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return queries.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def log_stream(changes: DataFrame, log: str, checkpoint: str, per_record: int = 1000, **trigger):
    """A streaming query that appends changes (type, vec_id, embedding) to a log as sealed records.

    A batch's records take the numbers after batch << 32, so a batch that is run again
    overwrites itself and readers see it once."""

    def run(batch: DataFrame, number: int) -> None:
        chunk = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-batch.count() // per_record))))
        rows = batch.withColumn("chunk", chunk).groupBy("type", "chunk").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("r"))
        rank = {"insert": 0, "update": 1, "delete": 2}
        order = F.create_map(*(F.lit(x) for pair in rank.items() for x in pair))[F.col("type")]
        seq = F.lit((number << 32) + 1).cast("bigint") + F.shiftleft(order.cast("bigint"), 24) + F.col("chunk")
        records = rows.select(seq.alias("seq"), "type", F.col("r.vec_id").alias("ids"), F.col("r.embedding").alias("vectors"))
        sealed(records).write.mode("overwrite").parquet(f"{log}/batch={number}")

    return changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class Batcher:
    """Joins searches of several threads into one: until `most` queries wait, or `wait` seconds have passed.

    Searches with another k are flushed first. After close(), waiting threads get an error."""

    def __init__(self, search, most: int = 32, wait: float = 0.05):
        if most < 1:
            raise InvalidArgument("a batch holds at least one query")
        self.search, self.most, self.wait = search, most, wait
        self.lock, self.batch, self.closed, self.last_size = threading.Condition(), None, False, 0

    def _flush(self, batch) -> None:
        """Runs a batch; the lock is held, and let go while the search runs."""
        if self.batch is batch:
            self.batch = None
        batch["state"] = "running"
        self.lock.release()
        try:
            result, error = self.search([q for q in batch["queries"]], batch["k"]), None
        except Exception as e:  # every waiting thread gets it
            result, error = None, e
        self.lock.acquire()
        batch |= {"state": "done", "result": result, "error": error}
        self.last_size = len(batch["queries"])
        self.lock.notify_all()

    def submit(self, queries: list, k: int) -> list:
        """The results of these queries, in their order."""
        with self.lock:
            if self.closed:
                raise RuntimeError("the batcher is closed")
            if self.batch is not None and self.batch["k"] != k:
                self._flush(self.batch)
            if self.batch is None:
                self.batch = {"k": k, "queries": [], "state": "open", "until": time.monotonic() + self.wait}
            mine = self.batch
            start = len(mine["queries"])
            mine["queries"] += queries
            if len(mine["queries"]) >= self.most:
                self._flush(mine)
            while mine["state"] != "done" and not (self.closed and mine["state"] == "open"):
                left = mine["until"] - time.monotonic()
                if mine["state"] == "open" and left <= 0:
                    self._flush(mine)
                else:
                    self.lock.wait(left if mine["state"] == "open" else None)
            if mine["state"] != "done":
                raise RuntimeError("the batcher was closed")
            if mine["error"] is not None:
                raise mine["error"]
            return mine["result"][start : start + len(queries)]

    def close(self) -> None:
        with self.lock:
            self.closed = True
            self.lock.notify_all()
