"""Row operators on parsed lines: time slices, filters, samples, context, edits, order and limits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.logfmt import PAIRS, escape, first_value_of_line, unescape
from ..plans.durations import SpecError, parse_bound
from ..plans.filters import parse, to_column
from ..plans.query import Query
from ..sources.logs import ORDER


def in_window(ns: Column, low: int | None, high: int | None) -> Column | None:
    """Closed interval; a line without a time is outside as soon as one side is set."""
    tests = ([ns >= F.lit(low)] if low is not None else []) + ([ns <= F.lit(high)] if high is not None else [])
    if not tests:
        return None
    test = tests[0] if len(tests) == 1 else tests[0] & tests[1]
    return F.coalesce(test, F.lit(False))


def anchors(df: DataFrame) -> tuple[int | None, int | None]:
    """(start, end): over files, the least first and the greatest last time by position."""
    place = F.struct("block_start", "row_id")
    timed = df.where("ts_ns is not null")
    ends = timed.groupBy("file_idx").agg(F.min_by("ts_ns", place).alias("first"), F.max_by("ts_ns", place).alias("last"))
    return tuple(ends.agg(F.min("first"), F.max("last")).first())


def window_of(query: Query, ends: DataFrame | Callable[[], tuple[int | None, int | None]]) -> tuple[int | None, int | None]:
    """The bounds in nanoseconds; ``ends``, parsed lines or what tells their anchors, is asked only if a bound has one."""
    low = parse_bound(query.time_from) if query.time_from is not None else None
    high = parse_bound(query.time_to) if query.time_to is not None else None
    start = end = None
    if any(b is not None and b.anchored for b in (low, high)):
        start, end = anchors(ends) if isinstance(ends, DataFrame) else ends()
    return low and low.resolve(start, end, False), high and high.resolve(start, end, True)


def span(df: DataFrame) -> tuple[int, int]:
    """Least and greatest time of all lines."""
    low, high = df.agg(F.min("ts_ns"), F.max("ts_ns")).first()
    if low is None:
        raise SpecError("no parseable timestamps in file")
    return low, high


def matched(query: Query, bounds: tuple[int | None, int | None]) -> Column:
    """Whether a line is in the window and passes all filters."""
    tests = [to_column(parse(e), F.col("pairs"), F.col("raw")) for e in query.where]
    window = in_window(F.col("ts_ns"), *bounds)
    out = window
    for test in tests:
        out = test if out is None else out & test
    return F.lit(True) if out is None else out


def sampled(query: Query) -> Column | None:
    """The sampler, which comes after all filters; rates 0 and 1 are exact."""
    if query.sample_rate is None:
        return None
    draw = F.rand(query.seed) if query.seed is not None else F.rand()
    keep = F.lit(bool(query.sample_rate)) if query.sample_rate in (0, 1) else draw < F.lit(query.sample_rate)
    if query.sample_if is None:
        return keep
    return ~to_column(parse(query.sample_if), F.col("pairs"), F.col("raw")) | keep


def first_n(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` lines in input order: a bounded heap on each task, no full sort."""
    return df.orderBy(*ORDER).limit(n)


def with_context(df: DataFrame, hit: Column, before: int, after: int, limit: int | None = None) -> DataFrame:
    """Matches and the lines around them within their file, with ``matched``; each line once.

    Only the stretches around matches are kept: a line counts if one of the ``after`` lines
    before it or of the ``before`` lines behind it matches. Nothing follows the last match
    under a limit.
    """
    within = Window.partitionBy("file_idx").orderBy("block_start", "row_id")
    df = df.withColumn("matched", hit)
    if limit is not None:
        number = F.sum(F.col("matched").cast("bigint")).over(Window.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0))
        df = df.withColumn("_n", number)
        df = df.withColumn("matched", F.col("matched") & (F.col("_n") <= limit))
        df = df.where((F.col("_n") < limit) | F.col("matched") & (F.col("_n") == limit)).drop("_n") if limit else df.limit(0).drop("_n")
    near = F.col("matched")
    if after:
        near = near | F.coalesce(F.max("matched").over(within.rowsBetween(-after, -1)), F.lit(False))
    if before:
        near = near | F.coalesce(F.max("matched").over(within.rowsBetween(1, before)), F.lit(False))
    return df.withColumn("_near", near).where("_near").drop("_near")


def edited(pairs: Column, remove: tuple[str, ...], add: tuple[tuple[str, str], ...]) -> Column:
    """Pairs with some appended and then all of some keys dropped, appended ones too."""
    if add:
        more = F.array(*(F.struct(F.lit(k).alias("k"), escape(F.lit(v)).alias("v")) for k, v in add)).cast(PAIRS)
        pairs = F.concat(pairs, more)
    if remove:
        pairs = F.filter(pairs, lambda p: ~p["k"].isin(*remove))
    return pairs


def value_of(key: str) -> Column:
    """Decoded first value of a key; null if no pair has it."""
    return unescape(first_value_of_line(F.col("raw"), key))


def sorted_by(df: DataFrame, key: str) -> DataFrame:
    """By the decoded value of a key, bytewise; a missing one is empty; ties in input order."""
    return df.orderBy(F.coalesce(value_of(key), F.lit("")), *ORDER)
