"""From a query and its inputs to DataFrames: relations for programs, text rows for the command line."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rows as out
from ..functions.logfmt import once
from ..operators import aggregates as agg
from ..operators import slicing as cut
from ..sources import logs
from .durations import SpecError, format_duration, parse_zone
from .query import Query


class Engine:
    """Answers queries over files, ``-`` for standard input among them, or over a relation of lines.

    ``relation`` has a string column ``value``; its order is that of its partitions.
    """

    def __init__(self, spark: SparkSession, files: list[str] | None = None, stdin: Iterable[str] | DataFrame | None = None, relation: DataFrame | None = None):
        self.spark, self.files = spark, files or []
        if relation is not None:
            read = logs.lines(spark, relation)
            self.streaming_order = False
        else:
            read = logs.read_all(spark, self.files, stdin)
            self.streaming_order = not self.files or "-" in self.files
        self.read = read
        self.real = read if "-" not in self.files else read.where(F.col("file_idx") != self.files.index("-"))

    def lines(self) -> DataFrame:
        return logs.parsed(logs.with_raw(self.read))

    # ------------------------------------------------------------ relations

    def window(self, query: Query) -> tuple[int | None, int | None]:
        """Bounds of the query; anchors come from real files only."""
        return cut.window_of(query, self.anchors)

    def anchors(self) -> tuple[int | None, int | None]:
        """The least first and the greatest last time of the files. Of few single files only the ends are read."""
        real = [f for f in self.files if f != "-"]
        if len(real) > logs.MANY or any(f.endswith(logs.TABLE) for f in real) or not real:
            return cut.anchors(logs.parsed(logs.with_raw(self.real)))
        first, last = [], []
        for f in real:
            df = logs.text_file(self.spark, f)
            if len(df.inputFiles()) > 1:
                return cut.anchors(logs.parsed(logs.with_raw(self.real)))
            timed = logs.parsed(logs.with_raw(df)).select("ts_ns").where("ts_ns is not null")
            if head := timed.head(1):
                first.append(head[0][0])
                last.append(timed.tail(1)[0][0])
        return min(first, default=None), max(last, default=None)

    def matched(self, query: Query, bounds: tuple[int | None, int | None] | None = None) -> DataFrame:
        """Matching lines; under a limit, the first of them in input order, before anything is added up."""
        bounds = self.window(query) if bounds is None else bounds
        df = self.lines()
        if "ts_ns" in self.read.columns:  # times of an ingested table: plain tests reach its statistics
            low, high = bounds
            df = df if low is None else df.where(F.col("ts_ns") >= low)
            df = df if high is None else df.where(F.col("ts_ns") <= high)
        df = df.where(cut.matched(query, bounds))
        if (sample := cut.sampled(query)) is not None:
            df = df.where(sample)
        return cut.first_n(df, query.limit) if query.limit is not None else df

    def grid(self, query: Query, bounds: tuple[int | None, int | None]) -> agg.Grid | None:
        if query.n_buckets is None:
            return agg.grid_of(query, bounds)
        low, high = bounds
        if low is None or high is None:
            start, end = self.anchors()
            low, high = start if low is None else low, end if high is None else high
        return agg.grid_of(query, (low, high))

    def counts(self, query: Query) -> DataFrame:
        """Counted rows in their order."""
        bounds = self.window(query)
        grid = self.grid(query, bounds)
        df = agg.counted(self.matched(query, bounds), query.group_by, grid, query.fill)
        return df.orderBy(*agg.ordering(query.group_by, grid, self.streaming_order and query.bucket is not None))

    def values(self, query: Query) -> DataFrame:
        """Decoded values of the raw key, in the order asked for."""
        df = self.matched(query)
        if query.sort_by is not None:
            df = cut.sorted_by(df, query.sort_by)
        elif not logs.in_order(self.files):
            df = df.orderBy(*logs.ORDER)
        return df.select(once(cut.value_of(query.raw_key)).alias("value")).where("value is not null")

    def selected(self, query: Query) -> DataFrame:
        """Matching lines, and those around them, in the order asked for, with ``matched``."""
        if query.lines_before or query.lines_after:
            bounds = self.window(query)
            hit = cut.matched(query, bounds)
            if (sample := cut.sampled(query)) is not None:
                hit = hit & sample
            df = cut.with_context(self.lines(), hit, query.lines_before, query.lines_after, query.limit)
            return df if query.sort_by is None else df.orderBy(F.col("matched").asc(), F.when(F.col("matched"), F.coalesce(cut.value_of(query.sort_by), F.lit(""))), *logs.ORDER)
        df = self.matched(query).withColumn("matched", F.lit(True))
        if query.sort_by is not None:
            return cut.sorted_by(df, query.sort_by)
        return df if logs.in_order(self.files) else df.orderBy(*logs.ORDER)

    def statistics(self, query: Query) -> dict[str, int]:
        """Counts over everything read."""
        df = self.read.withColumn("raw", logs.line_of(F.col("value")))
        df, seen = agg.statistics(logs.parsed(df), cut.matched(query, self.window(query)))
        df.select("row_id").write.format("noop").mode("overwrite").save()
        return dict(seen.get)

    # ------------------------------------------------------------ text

    def output(self, query: Query) -> list[DataFrame]:
        """What the command line prints: DataFrames of ``line``, one after the other."""
        query.check_inputs(self.files)
        zone = parse_zone(query.zone)
        if query.time_range:
            return [self._range(zone)]
        parts = self.printed(query)
        if query.list_keys:
            parts.append(self._set(agg.distinct_keys(self.matched(query)), "key", query.json))
        if query.list_values:
            parts.append(self._values(query, agg.distinct_values(self.matched(query), query.list_values)))
        if query.count:
            parts.append(self._counts(query, zone))
        return parts

    def printed(self, query: Query) -> list[DataFrame]:
        """The part of ``output`` that comes before all summaries: values of a raw key, or lines."""
        parts = []
        if query.raw_key is not None:
            parts.append(self.values(query).select(F.col("value").alias("line")))
        elif query.prints_lines or query.lines_before or query.lines_after:
            parts.append(self._lines(query))
        return parts

    def _lines(self, query: Query) -> DataFrame:
        df = self.selected(query)
        if not query.prints_lines:
            df = df.where(~F.col("matched"))
        # a carriage return before the line end stays, but for JSON and colour
        whole = F.concat("raw", "cr") if "cr" in df.columns else F.col("raw")
        if query.passthrough:
            return df.select(whole.alias("line"))
        pairs = cut.edited(F.col("pairs"), query.remove, query.add)
        plain = F.concat(out.logfmt_row(pairs), F.col("cr")) if "cr" in df.columns else out.logfmt_row(pairs)
        text = out.json_row(pairs) if query.json else out.color_row(pairs) if query.color else plain
        return df.select(F.when(F.col("matched"), text).otherwise(whole).alias("line"))

    def _set(self, df: DataFrame, column: str, json: bool) -> DataFrame:
        if not json:
            return df.select(F.col(column).alias("line"))
        items = F.array_sort(F.collect_set(column))
        return df.agg(F.concat(F.lit("["), F.array_join(F.transform(items, out.json_text), ","), F.lit("]")).alias("line"))

    def _values(self, query: Query, df: DataFrame) -> DataFrame:
        if query.json:
            item = out.json_text(F.col("value"))
            if len(query.list_values) > 1:
                item = F.concat(F.lit('{"key":'), out.json_text(F.col("key")), F.lit(',"value":'), item, F.lit("}"))
            items = F.transform(F.array_sort(F.collect_list(F.struct("i", "value", item.alias("item")))), lambda s: s["item"])
            return df.agg(F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")).alias("line"))
        if len(query.list_values) == 1:
            return df.select(F.col("value").alias("line"))
        heads = self.spark.createDataFrame([(i, f"# {k}") for i, k in enumerate(query.list_values)], "i int, line string").select("i", F.lit("").alias("o"), "line")
        body = df.select("i", F.concat(F.lit("v"), "value").alias("o"), F.col("value").alias("line"))
        return heads.unionByName(body).orderBy("i", "o").select("line")

    def _counts(self, query: Query, zone: str) -> DataFrame:
        bucketed = query.bucket is not None or query.n_buckets is not None
        if not query.group_by and not bucketed:
            return self._total(query, self.matched(query).agg(F.count(F.lit(1)).alias("count")))
        text = out.json_counted if query.json else out.logfmt_count
        return self.counts(query).select(text(query.group_by, bucketed, zone).alias("line"))

    def _total(self, query: Query, n: DataFrame) -> DataFrame:
        return n.select((F.concat(F.lit('{"count":'), out.json_count(F.col("count")), F.lit("}")) if query.json else F.col("count").cast("string")).alias("line"))

    def _range(self, zone: str) -> DataFrame:
        try:
            low, high = cut.span(self.lines())
        except SpecError as e:
            return self.spark.createDataFrame([(str(e),)], "line string")
        ends = self.spark.createDataFrame([(low, high)], "a long, b long")
        text = F.concat(out.format_ns(F.col("a"), zone), F.lit(" .. "), out.format_ns(F.col("b"), zone), F.lit(f"  ({format_duration(high - low)})"))
        return ends.select(text.alias("line"))
