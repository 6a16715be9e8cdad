"""Counts by key tuple and time bucket, distinct keys and values, and run statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.logfmt import first_value_of_line, unescape
from ..functions.times import floor_to, parse_ns
from ..plans.durations import parse_duration
from ..plans.query import Query, QueryError


@dataclass(frozen=True)
class Grid:
    """Buckets of ``width`` nanoseconds: aligned to 1970, or ``n`` of them from ``start`` on."""

    width: int
    start: int = 0
    n: int | None = None

    def bucket(self, ns: Column) -> Column:
        if self.n is None:
            return floor_to(ns, self.width)
        shifted = ns - F.lit(self.start)
        index = F.call_function("div", shifted - F.pmod(shifted, F.lit(self.width)), F.lit(self.width))
        return F.lit(self.start) + F.least(F.greatest(index, F.lit(0)), F.lit(self.n - 1)) * F.lit(self.width)


def grid_of(query: Query, window: tuple[int | None, int | None]) -> Grid | None:
    """The grid that a query asks for; ``window`` is the active window, needed for N buckets."""
    if query.bucket is not None:
        return Grid(parse_duration(query.bucket))
    if query.n_buckets is None:
        return None
    low, high = window
    if low is None or high is None or high <= low:
        raise QueryError("n-buckets needs a window that isn't empty")
    width = (high - low) // query.n_buckets
    if width <= 0:
        raise QueryError("the window is shorter than n-buckets nanoseconds")
    return Grid(width, low, query.n_buckets)


def key_columns(keys: tuple[str, ...]) -> list[Column]:
    """Group keys: the decoded first value, or the empty text where the key is missing."""
    return [F.coalesce(unescape(first_value_of_line(F.col("raw"), k)), F.lit("")).alias(f"key.{k}") for k in keys]


def counted(df: DataFrame, keys: tuple[str, ...] = (), grid: Grid | None = None, fill: bool = False) -> DataFrame:
    """count, first and last time by key tuple and bucket.

    With a grid, lines without a time make no row. Only buckets that saw a line have one;
    ``fill`` adds empty ones of an N-bucket grid to ungrouped counts.
    """
    by = key_columns(keys)
    names = [f"key.{k}" for k in keys]
    rows = df.select(*by, "ts_ns")
    if grid:
        # through a generator, so that the filter doesn't have the time parsed once more
        rows = df.select(*by, F.explode(F.array("ts_ns")).alias("ts_ns")).where("ts_ns is not null")
        rows = rows.withColumn("bucket_start_ns", grid.bucket(F.col("ts_ns")))
        names.append("bucket_start_ns")
    out = rows.groupBy(*(F.col(f"`{n}`") for n in names)).agg(F.count(F.lit(1)).alias("count"), F.min("ts_ns").alias("time_start_ns"), F.max("ts_ns").alias("time_end_ns"))
    if fill and grid and grid.n and not keys:
        every = df.sparkSession.range(grid.n).select((F.lit(grid.start) + F.col("id") * grid.width).alias("bucket_start_ns"))
        out = every.join(out, "bucket_start_ns", "left").fillna(0, ["count"])
    if grid:
        out = out.withColumn("bucket_end_ns", F.col("bucket_start_ns") + grid.width)
    return out


def ordering(keys: tuple[str, ...], grid: Grid | None, streaming: bool = False) -> list[Column]:
    """Order of rows: by falling count, keys and bucket; of a stream by bucket, falling count and keys."""
    names = [F.col(f"`key.{k}`").asc() for k in keys]
    bucket = [F.col("bucket_start_ns").asc()] if grid else []
    return [*bucket, F.desc("count"), *names] if streaming else [F.desc("count"), *names, *bucket]


def distinct_keys(df: DataFrame) -> DataFrame:
    """Every key of any line, sorted."""
    return df.select(F.explode(F.transform("pairs", lambda p: p["k"])).alias("key")).distinct().orderBy("key")


def distinct_values(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Distinct decoded first values of each key, sorted; a key asked for twice is reported twice."""
    each = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(k).alias("key"), unescape(first_value_of_line(F.col("raw"), k)).alias("value")) for i, k in enumerate(keys)))
    rows = df.select(F.inline(each)).where("value is not null").distinct()
    return rows.orderBy("i", "value")


def statistics(df: DataFrame, hit: Column) -> tuple[DataFrame, Observation]:
    """Lines, matches, pairs, lines over the pair limit and bytes, gathered while ``df`` is used for something else.

    ``df`` has ``value`` as read. Lines that aren't UTF-8 count as lines and as invalid only.
    """
    seen = Observation()
    good = F.is_valid_utf8("value")
    out = df.observe(
        seen,
        F.count(F.lit(1)).alias("lines"),
        F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum((~good).cast("bigint")), F.lit(0)).alias("invalid_utf8"),
        F.coalesce(F.sum((good & hit).cast("bigint")), F.lit(0)).alias("matched"),
        F.coalesce(F.sum(F.when(good, F.size("pairs"))), F.lit(0)).alias("pairs"),
        F.coalesce(F.sum(F.when(good, F.col("overflow").cast("bigint"))), F.lit(0)).alias("overflow"),
    )
    return out, seen


def top_totals(rows: DataFrame, keys: tuple[str, ...], k: int) -> DataFrame:
    """The ``k`` key tuples of the greatest totals over all buckets; ties by keys."""
    names = [F.col(f"`key.{x}`") for x in keys]
    return rows.groupBy(*names).agg(F.sum("count").alias("total")).orderBy(F.desc("total"), *names).limit(k)


def series(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(bucket, count) of each key tuple in order of time."""
    names = [F.col(f"`key.{x}`") for x in keys]
    points = F.array_sort(F.collect_list(F.struct("bucket_start_ns", "count")))
    return rows.groupBy(*names).agg(points.alias("points"))


def totals(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row: total, key tuples, buckets, span in nanoseconds and lines per second over it."""
    names = [F.col(f"`key.{x}`") for x in keys]
    combos = F.count_distinct(F.struct(*names)) if keys else F.lit(1).cast("bigint")
    out = rows.agg(
        F.sum("count").alias("total"), combos.alias("combos"), F.count_distinct("bucket_start_ns").alias("buckets"), F.min("time_start_ns").alias("first_ns"), F.max("time_end_ns").alias("last_ns")
    )
    seconds = (F.col("last_ns") - F.col("first_ns")) / 1e9
    return out.withColumn("span_ns", F.col("last_ns") - F.col("first_ns")).withColumn("rate", F.when(seconds > 0, F.col("total") / seconds))


def raw_totals(df: DataFrame) -> DataFrame:
    """One row over lines: their number, distinct levels, span and rate."""
    level = unescape(first_value_of_line(F.col("raw"), "level"))
    out = df.agg(F.count(F.lit(1)).alias("lines"), F.count_distinct(level).alias("levels"), (F.max("ts_ns") - F.min("ts_ns")).alias("span_ns"))
    return out.withColumn("rate", F.when(F.col("span_ns") > 0, F.col("lines") / (F.col("span_ns") / 1e9)))


def classified(df: DataFrame) -> DataFrame:
    """Parsed lines as a dashboard reads them: counted rows, whose first key is a whole ``count``, and others, whose count is null.

    ``combo``: the ``key.`` pairs of a counted row as (key, value), sorted; and its times in nanoseconds.
    """
    first = F.get(F.col("pairs"), F.lit(0))
    number = F.trim(unescape(first["v"]))
    counted = F.coalesce((first["k"] == "count") & number.rlike(r"\A[+-]?\d+\z"), F.lit(False))
    rest = F.slice("pairs", F.lit(2), F.size("pairs"))
    keys = F.transform(F.filter(rest, lambda p: p["k"].startswith("key.")), lambda p: F.struct(F.substring(p["k"], 5, 2**31 - 1).alias("key"), unescape(p["v"]).alias("value")))
    times = [F.when(counted, parse_ns(unescape(first_value_of_line(F.col("raw"), name)))).alias(column) for name, column in (("bucket.start", "bucket_start_ns"), ("time.start", "time_start_ns"), ("time.end", "time_end_ns"))]
    return df.select("raw", F.when(counted, number.try_cast("bigint")).alias("count"), F.when(counted, F.array_sort(keys)).alias("combo"), *times)


def position(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Adds ``pos``, the number of a row in an order, for results whose order matters to a reader without one."""
    return rows.withColumn("pos", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
