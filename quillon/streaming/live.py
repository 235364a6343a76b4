"""Live queries, change streams and event-time windows."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..errors import EngineError
from ..plans.filters import matching


class Watch:
    """Fresh snapshots of a query after writes; several writes between two looks are one."""

    def __init__(self, collection, query: Callable[[], DataFrame]):  # noqa: ANN001
        self.collection, self.query = collection, query
        self.seen, self.closed = collection.generation, False

    def try_next(self) -> DataFrame | None:
        """The snapshot, if there was a write since the last one."""
        if self.closed:
            raise EngineError("WatchClosed", "the watch is closed")
        now = self.collection.generation
        if now == self.seen:
            return None
        self.seen = now
        return self.query()

    def next(self, timeout: float, poll: float = 0.1) -> DataFrame | None:
        """The next snapshot, or None when ``timeout`` seconds have passed."""
        until = time.monotonic() + timeout
        while (found := self.try_next()) is None and time.monotonic() < until:
            time.sleep(poll)
        return found

    def close(self) -> None:
        self.closed = True


def watch(collection, filter: object = None) -> Watch:  # noqa: A002, ANN001
    return Watch(collection, lambda: collection.find(filter))


def watch_aggregate(collection, pipeline: object) -> Watch:  # noqa: ANN001
    return Watch(collection, lambda: collection.aggregate(pipeline))


class Subscription:
    """A first snapshot at once, then one whenever the result differs. ``poll()`` looks once. A
    snapshot goes to the driver, so one of more than ``most`` rows is refused."""

    def __init__(self, live: Watch, deliver: Callable[[list[Row]], None], most: int = 100_000):
        self.live, self.deliver, self.last, self.most = live, deliver, None, most
        self._send(live.query())

    def _send(self, df: DataFrame) -> bool:
        rows = df.limit(self.most + 1).collect()
        if len(rows) > self.most:
            raise EngineError("ChangesetTooLarge", f"the result has more than {self.most} rows")
        shape = json.dumps([r.asDict(recursive=True) for r in rows], default=str, sort_keys=True)
        if shape == self.last:
            return False
        self.last = shape
        self.deliver(rows)
        return True

    def poll(self) -> bool:
        found = self.live.try_next()
        return found is not None and self._send(found)


# --- change streams ----------------------------------------------------------------------------


def changes(events: DataFrame, filter: object, since: object = None, key: str = "event_id") -> DataFrame:  # noqa: A002
    """Matching events after ``since``: works alike on a table and on a stream of its files."""
    out = matching(events, filter)
    return out if since is None else out.filter(F.col(key) > since)


def windowed_counts(events: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "2 hours", time_col: str = "ts", by: str = "event_type") -> DataFrame:
    """Event-time windows with a watermark: ``window_start, <by>, n, total``. Late rows within the
    watermark count; a stream keeps state for no longer than that."""
    timed = events.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late)
    grouped = timed.groupBy(F.window(time_col, window, slide or window).alias("w"), by)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), by, "n", "total")


def run_available(stream: DataFrame, table: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Everything that a stream has now, as the in-memory table ``table`` (for small results)."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(table)


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, **trigger: object) -> StreamingQuery:
    """Run ``work(frame, batch number)`` on every micro-batch."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


# --- webhook sink ------------------------------------------------------------------------------

#: Request methods by operation, and the waits in seconds before each retry.
METHODS = {"insert": "POST", "update": "PUT", "delete": "DELETE"}
RETRIES = (0.2, 0.4, 0.8)


def send(url: str, event: dict, headers: dict | None = None, opener: Callable = urllib.request.urlopen, sleep: Callable[[float], None] = time.sleep) -> bool:
    """One request for a change, retried on server and network errors, not on client errors."""
    request = urllib.request.Request(url, json.dumps(event, default=str).encode(), {"Content-Type": "application/json", **(headers or {})}, method=METHODS[event["op"]])
    for wait in (*RETRIES, None):
        try:
            with opener(request, timeout=10):
                return True
        except urllib.error.HTTPError as e:
            if e.code < 500:
                return False
        except OSError:
            pass
        if wait is not None:
            sleep(wait)
    return False


def webhook(url: str, failed: str, collections: Iterable[str] | None = None, exclude: Iterable[str] = (), headers: dict | None = None, post: Callable[[str, dict, dict | None], bool] = send) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink for a change feed ``collection, op, doc_id, ts, ...``: one request per
    document change, a document's changes in order. What could not be delivered is appended to the
    table at ``failed``."""
    allowed, hidden = None if collections is None else frozenset(collections), frozenset(exclude)

    def work(batch: DataFrame, number: int) -> None:
        chosen = batch if allowed is None else batch.filter(F.col("collection").isin(*allowed))
        names = chosen.columns

        def deliver(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                sent = [post(url, {k: v for k, v in r.items() if k not in hidden}, headers) for r in rows.to_dict("records")]
                yield rows[[not x for x in sent]][names]

        ordered = chosen.repartition("collection", "doc_id").sortWithinPartitions("collection", "doc_id", "ts")
        ordered.mapInPandas(deliver, chosen.schema).withColumn("batch", F.lit(number).cast("long")).write.mode("append").parquet(failed)

    return work


def deliver_changes(database, since: dict[str, int], work: Callable[[DataFrame, int], None]) -> dict[str, int]:  # noqa: ANN001
    """Hand the commits after ``since`` to a sink; the generations to go on from. Kept by the caller,
    they make delivery at least once."""
    now = {n: database.collection(n).manifest()["generation"] for n in database.collections()}
    feed = database.changes(since).filter(_until(now))
    work(feed, max(now.values(), default=0))
    return now


def _until(now: dict[str, int]) -> Column:
    return reduce(lambda a, b: a | b, ((F.col("collection") == n) & (F.col("generation") <= g) for n, g in now.items()), F.lit(False))


def stream_of(spark, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:  # noqa: ANN001
    """A directory of parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
