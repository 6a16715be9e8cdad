"""Time buckets of a stream, emitted as they close.

Two modes. ``watermarked`` is Spark's own: append mode under a watermark, which drops late
lines. ``BucketStream`` is exact: a bucket closes when a matching line is later than its
end by more than the grace, over all groups; a late line opens its bucket again, which gives
a second row for it. Its state is the open buckets, a table written per batch, so a batch
that is run again replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rows as out
from ..operators import aggregates as agg
from ..plans.durations import parse_zone
from ..plans.query import Query
from ..sources import scratch

NS = 1_000_000_000


def watermarked(matched: DataFrame, keys: tuple[str, ...], bucket_ns: int, grace_ns: int) -> DataFrame:
    """Counts of a streaming relation of matched lines by bucket; closes late by up to the grace, drops what is later.

    Spark closes a bucket when the watermark reaches its end; a millisecond more makes that
    strictly later, as in the exact mode. Watermarks count in milliseconds.
    """
    ts = F.timestamp_micros(F.floor(F.col("ts_ns") / 1000)).alias("ts")
    df = matched.select(*agg.key_columns(keys), "ts_ns", ts).where("ts_ns is not null")
    df = df.withWatermark("ts", f"{grace_ns // 1_000_000 + 1} milliseconds")
    window = F.window("ts", f"{bucket_ns // 1000} microseconds")
    rows = df.groupBy(window.alias("w"), *(F.col(f"`key.{k}`") for k in keys)).agg(F.count(F.lit(1)).alias("count"), F.min("ts_ns").alias("time_start_ns"), F.max("ts_ns").alias("time_end_ns"))
    return rows.select(F.expr("unix_micros(w.start) * 1000").alias("bucket_start_ns"), F.expr("unix_micros(w.end) * 1000").alias("bucket_end_ns"), *(F.col(f"`key.{k}`") for k in keys), "count", "time_start_ns", "time_end_ns")


class BucketStream:
    """Open buckets of a query, kept under ``path``; used from ``foreachBatch``."""

    def __init__(self, spark: SparkSession, query: Query, path: str | None = None):
        self.spark, self.query = spark, query
        self.grid = agg.grid_of(query, (None, None))
        self.grace = query.window_secs * NS
        self.path = path or scratch.folder(spark, "buckets")
        self.latest: int | None = None  # greatest time of a matched line
        self.version = 0
        self.state: DataFrame | None = None
        self._batch: tuple | None = None

    def _names(self) -> list[str]:
        return [f"key.{k}" for k in self.query.group_by] + ["bucket_start_ns"]

    def add(self, matched: DataFrame, batch_id: int | None) -> None:
        """Adds a batch of matched lines; the same id again starts from the state before it."""
        if batch_id is not None and self._batch and self._batch[0] == batch_id:
            _, self.state, self.latest = self._batch
        self._batch = (batch_id, self.state, self.latest)
        rows = agg.counted(matched, self.query.group_by, self.grid)
        if self.state is not None:
            rows = rows.unionByName(self.state)
        names = [F.col(f"`{n}`") for n in self._names()]
        rows = rows.groupBy(*names).agg(F.sum("count").alias("count"), F.min("time_start_ns").alias("time_start_ns"), F.max("time_end_ns").alias("time_end_ns"))
        self._keep(rows.withColumn("bucket_end_ns", F.col("bucket_start_ns") + self.grid.width))
        seen = self.state.agg(F.max("time_end_ns")).first()[0]
        if seen is not None:
            self.latest = seen if self.latest is None else max(seen, self.latest)

    def _keep(self, rows: DataFrame) -> None:
        """Writes the open buckets as the next version and goes on from there."""
        self.version += 1
        path = f"{self.path}/v{self.version}"
        rows.write.mode("overwrite").parquet(path)
        self.state = self.spark.read.schema(rows.schema).parquet(path)

    def _text(self, rows: DataFrame) -> list[str]:
        """Rows in order of bucket, falling count and keys; closed buckets are few."""
        text = (out.json_counted if self.query.json else out.logfmt_count)(self.query.group_by, True, parse_zone(self.query.zone))
        return [r["line"] for r in rows.orderBy(*agg.ordering(self.query.group_by, self.grid, True)).select(text.alias("line")).toLocalIterator()]

    def closed_rows(self) -> DataFrame | None:
        """Buckets that are closed now; they leave the state."""
        if self.state is None or self.latest is None:
            return None
        done = F.col("bucket_end_ns") + F.lit(self.grace) < F.lit(self.latest)
        rows = self.state.where(done)
        if rows.isEmpty():
            return None
        before = self.state
        self._keep(before.where(~done))
        return rows

    def closed(self) -> list[str]:
        rows = self.closed_rows()
        return [] if rows is None else self._text(rows)

    def finish(self) -> list[str]:
        """What is still open, at the end of the stream."""
        if self.state is None:
            return []
        rows, self.state = self.state, None
        return self._text(rows)
