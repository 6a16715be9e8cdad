"""Following a growing file: a streaming data source over byte positions, and the live command.

An offset is the device, inode and position of the file. It never passes the last line
end, so a line still being written waits; when a file is replaced or cut short (and
``reopen`` is set), what the old one still holds is read first and the new one from its start.
For that the reader keeps the file open, and stays with it until it is read to its end and no
line in it is unfinished. The limit: after a restart, what was not read of a file that has been
replaced meanwhile, or is to be replayed from it, can't be found under its path; the reader
warns and goes on without it. The same holds before the reader has opened the file first.
"""

from __future__ import annotations

import os
import threading
import time
import warnings
from collections import deque
from collections.abc import Iterable, Iterator
from functools import reduce
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..operators import aggregates as agg
from ..operators import slicing as cut
from ..plans.query import Query
from ..sources import logs, scratch

#: Bytes that a micro-batch reads at most, unless one line is longer.
CHUNK = 8 << 20
#: Bytes of lines from standard input that wait for an answer at most, about; what a line takes besides its text.
HELD, LINE = 64 << 20, 100


def _whole_lines(f: BinaryIO, start: int, most: int = CHUNK) -> tuple[list[bytes], int]:
    """Whole lines from ``start`` on and the position behind them."""
    f.seek(start)
    data = f.read(most)
    while data and b"\n" not in data and (more := f.read(most)):
        data += more
    end = data.rfind(b"\n") + 1
    return data[:end].split(b"\n")[:-1], start + end


class TailReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.reopen = options.get("reopen", "false").lower() == "true"
        self.start = options.get("startingoffset", options.get("startingOffset", "latest"))

        self.file: BinaryIO | None = None  # the followed file, also under another name

    def __getstate__(self) -> dict:
        return self.__dict__ | {"file": None}

    def _open(self) -> dict | None:
        """Holds the file that the path has now; its identity, or nothing if there is none."""
        try:
            file = open(self.path, "rb")  # noqa: SIM115
        except FileNotFoundError:
            return None
        if self.file is not None:
            self.file.close()
        self.file = file
        return _identity(os.fstat(file.fileno()))

    def _holds(self, offset: dict) -> bool:
        return self.file is not None and _same(_identity(os.fstat(self.file.fileno())), offset)

    def initialOffset(self) -> dict:
        who = self._open()
        if who is None:
            raise FileNotFoundError(self.path)
        if self.start == "earliest":
            at = 0
        elif self.start == "latest":
            at = os.fstat(self.file.fileno()).st_size
        else:
            at = int(self.start)
        return who | {"pos": at}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._read(start)
        return iter(rows), end

    def _read(self, start: dict) -> tuple[list[tuple], dict]:
        if self._holds(start):
            size = os.fstat(self.file.fileno()).st_size
            if size > start["pos"]:
                # with an unfinished line alone, the position stays and the file is kept
                return self._rows(start)
            try:
                s = os.stat(self.path)
            except FileNotFoundError:  # for a moment, while it is replaced
                return [], start
            if not self.reopen or size == start["pos"] and _same(_identity(s), start):
                return [], start
            # written between the look at the size and the one at the path
            if os.fstat(self.file.fileno()).st_size > start["pos"]:
                return self._rows(start)
            who = self._open()
        else:
            who = self._open()
            if who is not None and _same(who, start) and os.fstat(self.file.fileno()).st_size >= start["pos"]:
                return self._rows(start)
            if who is not None and self.reopen and not _same(who, start):
                warnings.warn(f"{self.path} was replaced before it could be held; what the old file had after byte {start['pos']} is not read", stacklevel=2)
        if who is None or not self.reopen:
            return [], start
        return self._rows(who | {"pos": 0})

    def _rows(self, start: dict) -> tuple[list[tuple], dict]:
        found, pos = _whole_lines(self.file, start["pos"])
        return [(x.decode(),) for x in found if _valid(x)], start | {"pos": pos}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        at = start["pos"] if _same(start, end) and start["pos"] <= end["pos"] else 0
        if not self._holds(end) and (who := self._open()) != _identity_of(end):
            warnings.warn(f"{self.path} is another file than that of the batch to replay, whose lines are not read ({who})", stacklevel=2)
            return iter([])
        self.file.seek(at)
        data = self.file.read(end["pos"] - at)
        return iter([(x.decode(),) for x in data.split(b"\n")[:-1] if _valid(x)])


def _identity(s: os.stat_result) -> dict:
    return {"dev": s.st_dev, "ino": s.st_ino}


def _identity_of(offset: dict) -> dict:
    return {"dev": offset["dev"], "ino": offset["ino"]}


def _same(a: dict, b: dict) -> bool:
    return _identity_of(a) == _identity_of(b)


def _valid(line: bytes) -> bool:
    try:
        line.decode()
    except UnicodeDecodeError:
        return False
    return True


class TailSource(DataSource):
    """``spark.readStream.format("logtail")``: options path, reopen, startingOffset (latest, earliest, a byte)."""

    @classmethod
    def name(cls) -> str:
        return "logtail"

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))


def tail(spark: SparkSession, path: str, reopen: bool = False, start: str = "latest") -> DataFrame:
    """Lines of a growing file as a streaming DataFrame of ``value``."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("logtail").option("path", path).option("reopen", str(reopen).lower()).option("startingOffset", start).load()


def parsed_stream(lines: DataFrame) -> DataFrame:
    """The parsed relation of a stream of ``value``; order within a batch is that of its rows."""
    df = lines.select(F.lit(0).alias("file_idx"), F.lit(0).cast("bigint").alias("block_start"), F.lit(0).cast("bigint").alias("row_id"), "value")
    return logs.parsed(logs.with_raw(df))


class Totals:
    """Count, keys and values of a query's matches over all batches, for the summaries at the end.

    Distinct keys and values are tables, one for each batch, which are folded into one from
    time to time.
    """

    FOLD = 50

    def __init__(self, spark: SparkSession, query: Query):
        self.spark, self.query, self.count = spark, query, 0
        self.path = scratch.folder(spark, "totals")
        self.tables: dict[str, list[DataFrame]] = {}
        self.written = 0

    @staticmethod
    def of(spark: SparkSession, query: Query) -> Totals | None:
        """Nothing if the query has no such summary; counts by bucket are told as the buckets close."""
        return Totals(spark, query) if query.list_keys or query.list_values or query.count and query.bucket is None else None

    def add(self, matched: DataFrame) -> None:
        if self.query.count and self.query.bucket is None:
            self.count += matched.count()
        if self.query.list_keys:
            self._keep("keys", agg.distinct_keys(matched))
        if self.query.list_values:
            self._keep("values", agg.distinct_values(matched, self.query.list_values))

    def _keep(self, name: str, rows: DataFrame) -> None:
        tables = self.tables.setdefault(name, [])
        tables.append(self._written(rows))
        if len(tables) >= self.FOLD:
            tables[:] = [self._written(self._all(name))]

    def _written(self, rows: DataFrame) -> DataFrame:
        self.written += 1
        path = f"{self.path}/{self.written}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _all(self, name: str) -> DataFrame:
        return reduce(DataFrame.unionByName, self.tables[name]).distinct()

    def finish(self) -> Iterator[str]:
        """The summaries, in the order in which ``Engine.output`` has them."""
        from ..plans.planner import Engine

        q, engine, parts = self.query, Engine(self.spark, []), []
        if q.list_keys:
            keys = self._all("keys") if "keys" in self.tables else self.spark.createDataFrame([], "key string")
            parts.append(engine._set(keys.orderBy("key"), "key", q.json))
        if q.list_values:
            values = self._all("values") if "values" in self.tables else self.spark.createDataFrame([], "i int, key string, value string")
            parts.append(engine._values(q, values.orderBy("i", "value")))
        if q.count and q.bucket is None:
            parts.append(engine._total(q, self.spark.createDataFrame([(self.count,)], "count long")))
        for part in parts:
            for row in part.toLocalIterator():
                yield row["line"]


class Context:
    """Picks matches and the lines around them, over all batches; each line once."""

    def __init__(self, before: int, after: int):
        self.waiting: deque[str] = deque(maxlen=before)  # what a later match may still ask for
        self.after, self.due = after, 0

    def add(self, lines) -> list[tuple[str, bool]]:
        """From (line, whether it matches) the same of those to print."""
        found = []
        for line, matched in lines:
            if matched:
                found += [*((x, False) for x in self.waiting), (line, True)]
                self.waiting.clear()
                self.due = self.after
            elif self.due:
                found.append((line, False))
                self.due -= 1
            else:
                self.waiting.append(line)
        return found


def tested(query: Query, window: tuple[int | None, int | None]):
    """Whether a line is matched, sampling included; never null."""
    hit = F.coalesce(cut.matched(query, window), F.lit(False))
    return hit if (sample := cut.sampled(query)) is None else hit & sample


class Live:
    """Answers a query over batches of parsed lines as they come; ``emit`` gets each line of output."""

    def __init__(self, spark: SparkSession, query: Query, emit):
        from .buckets import BucketStream

        self.spark, self.query, self.emit = spark, query, emit
        self.buckets = BucketStream(spark, query) if query.bucket is not None else None
        self.totals = Totals.of(spark, query)
        self.around = query.lines_before + query.lines_after if query.raw_key is None else 0
        self.context = Context(query.lines_before, query.lines_after)

    def count(self, matched: DataFrame, batch_id: int | None) -> None:
        """What is added up."""
        if self.buckets:
            self.buckets.add(matched, batch_id)
            for line in self.buckets.closed():
                self.emit(line)
        if self.totals:
            self.totals.add(matched)

    def add(self, df: DataFrame, batch_id: int) -> None:
        """A batch of lines with ``matched``."""
        from ..plans.planner import Engine

        if self.buckets and not (self.totals or self.around or self.query.raw_key is not None or self.query.prints_lines):
            self.count(df.where("matched"), batch_id)  # the one pass over the lines
            return
        df = df.persist()
        try:
            rows = df.where("matched")
            self.count(rows, batch_id)
            shown = rows
            if self.around:
                found = self.context.add(df.select(F.concat("raw", "cr").alias("value"), "matched").toLocalIterator())
                if not found:
                    return
                shown = logs.parsed(logs.with_raw(self.spark.createDataFrame(found, "value string, matched boolean")))
            one = Engine(self.spark, [])
            one.selected, one.matched = (lambda q: shown), (lambda q, b=None: rows)  # type: ignore[method-assign]
            for part in one.printed(self.query):
                for row in part.toLocalIterator():
                    self.emit(row["line"])
        finally:
            df.unpersist()

    def finish(self) -> None:
        """What is still open, and summaries over all that was read."""
        for line in self.buckets.finish() if self.buckets else []:
            self.emit(line)
        for line in self.totals.finish() if self.totals else []:
            self.emit(line)


def can_listen(query: Query) -> bool:
    """Whether a query can be answered batch by batch: nothing in it waits for the last line but sums, keys and values."""
    waits = query.sort_by is not None or query.limit is not None or query.n_buckets is not None or query.time_range
    return not waits and not (query.count and query.bucket is None and query.group_by)


class Waiting:
    """Lines that came and wait for an answer, between a thread that puts them and one that takes them."""

    def __init__(self, lines: Iterable[str]):
        self.lines: list[str] = []
        self.size, self.over, self.error = 0, False, None
        self.changed = threading.Condition()
        threading.Thread(target=self._put, args=(lines,), daemon=True).start()

    def _put(self, lines: Iterable[str]) -> None:
        try:
            for line in lines:
                with self.changed:
                    while self.size >= HELD and not self.over:
                        self.changed.wait()
                    if self.over:
                        return
                    self.lines.append(line)
                    self.size += len(line) + LINE
                    self.changed.notify()
        except BaseException as e:  # the input isn't whole, which whoever takes the lines must know
            self.error = e
        finally:
            self.close()

    def close(self) -> None:
        """Nothing is put any more."""
        with self.changed:
            self.over = True
            self.changed.notify()

    def take(self, enough: int, wait: float) -> list[str]:
        """All lines that wait, as soon as they are enough or the first of them has waited; none at the end."""
        with self.changed:
            self.changed.wait_for(lambda: self.lines or self.over)
            self.changed.wait_for(lambda: len(self.lines) >= enough or self.size >= HELD or self.over, wait)
            part, self.lines, self.size = self.lines, [], 0
            self.changed.notify()
        if not part and self.error is not None:
            raise self.error
        return part


def listen(spark: SparkSession, lines: Iterable[str], query: Query, emit, most: int = 50_000, wait: float = 0.5) -> None:
    """Answers a query over lines while they come, as from a pipe: buckets are printed as they close, matches at once.

    A batch is asked for as soon as ``most`` lines wait, or those that came within ``wait`` seconds. It
    has all that wait by then: while answers are slower than the input, batches grow up to ``HELD``
    bytes, so that the number of Spark jobs doesn't follow that of the lines. No more than two such batches are held.
    At the end come open buckets and summaries.
    """
    from ..plans.planner import Engine

    live, hit = Live(spark, query, emit), tested(query, Engine(spark, []).window(query))
    waiting, batch_id = Waiting(lines), 0
    try:
        while part := waiting.take(most, wait):
            live.add(logs.parsed(logs.with_raw(logs.held(spark, part))).withColumn("matched", hit), batch_id)
            batch_id += 1
    finally:
        waiting.close()
    live.finish()


def follow(spark: SparkSession, files: list[str], query: Query, emit, until=None, poll: str = "200 milliseconds", apply_bounds: bool = True) -> None:
    """Answers a query over the files as they are, then over what comes into the last one.

    A single file starts at its end unless there is a lower bound; with several, the last
    is read in full first. ``emit`` gets each line of output. ``until()`` ends it, as an
    interrupt does; open buckets are then emitted too, and counts without buckets, keys and
    values, each over all that was read. Context goes on from batch to batch. Bounds also hold for what comes
    later; with ``apply_bounds=False`` they hold for the first reading only.
    """
    from ..plans.planner import Engine

    last, engine = files[-1], Engine(spark, files)
    from_start = len(files) > 1 or query.time_from is not None
    bounds = engine.window(query)
    live = Live(spark, query, emit)
    position = len(_whole(last))
    if from_start:
        live.count(engine.matched(query, bounds), None)
        for part in engine.printed(query):
            for row in part.toLocalIterator():
                emit(row["line"])
        if live.around:  # the first batch goes on behind the last lines of the first reading
            ends = engine.lines().where(F.col("file_idx") == len(files) - 1).withColumn("matched", tested(query, bounds))
            ends = ends.orderBy(*(F.desc(c) for c in logs.ORDER)).limit(live.around).select(F.concat("raw", "cr").alias("value"), "matched").collect()
            live.context.add(reversed(ends))
    hit = tested(query, bounds if apply_bounds else (None, None))
    stream = parsed_stream(tail(spark, last, query.reopen, str(position)))
    running = stream.writeStream.foreachBatch(lambda df, batch_id: live.add(df.withColumn("matched", hit), batch_id)).trigger(processingTime=poll).start()
    try:
        while running.isActive and not (until and until()):
            running.awaitTermination(0.2)
    except KeyboardInterrupt:
        pass
    finally:
        running.stop()
        live.finish()


def _whole(path: str) -> range:
    """As long as the file up to its last line end."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        at = size
        while at > 0:
            step = min(1 << 16, at)
            f.seek(at - step)
            k = f.read(step).rfind(b"\n")
            if k >= 0:
                return range(at - step + k + 1)
            at -= step
    return range(0)
