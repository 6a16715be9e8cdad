"""Batch sources of log lines: text files, archives, and relations of lines.

All give the relation that every operator takes: ``file_idx, block_start, row_id, raw`` and,
once parsed, ``pairs, overflow, ts_ns``. ``(file_idx, block_start, row_id)`` is the order
of the lines; it is attached only where an operator asks for order.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import islice, pairwise

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.logfmt import line_of, overflow, pairs
from ..functions.times import time_of
from . import scratch, seekable

ORDER = ["file_idx", "block_start", "row_id"]
#: Extensions that Spark's text source decodes itself, and those that need a decoder here.
SPARK_ARCHIVES, OTHER_ARCHIVES = (".zst", ".gz", ".bz2"), (".zstd", ".seekztd")
#: What the path of a table of lines ends in that ``ingest`` wrote.
TABLE = ".lines"
_CHUNK = 4 << 20
#: Inputs from which all text files are one scan rather than one each; lines of standard input that are spooled at once.
MANY, SPOOL = 8, 50_000
#: Lines of a piece in which the driver sends those that it holds.
_PIECE = 10_000


def _numbered(df: DataFrame, file_idx: int, block) -> DataFrame:
    return df.select(F.lit(file_idx).alias("file_idx"), block.cast("bigint").alias("block_start"), F.monotonically_increasing_id().alias("row_id"), "value")


def text_file(spark: SparkSession, path: str, file_idx: int = 0) -> DataFrame:
    """Lines of one file, split at LF only; ``.zst`` goes through Hadoop's codec, other zstd names through ``zstandard``.

    A table that ``ingest`` wrote is read as its lines, with their times, which prune.
    """
    if path.endswith(OTHER_ARCHIVES):
        return archive(spark, path, file_idx)
    if path.endswith(TABLE):
        rows = spark.read.parquet(path)
        return rows.select(F.lit(file_idx).alias("file_idx"), "block_start", "row_id", "value", "ts_ns")
    df = spark.read.option("lineSep", "\n").text(path)
    return _numbered(df.select("value", F.col("_metadata.file_block_start").alias("b")), file_idx, F.col("b"))


def text_files(spark: SparkSession, files: list[tuple[int, str]]) -> DataFrame:
    """Lines of many plain files, each named once, in one scan: a file's number is found by its path."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def whole(path: str) -> str:
        at = jvm.org.apache.hadoop.fs.Path(path)
        return re.sub("^file:/+", "file:/", at.getFileSystem(conf).makeQualified(at).toUri().toString())

    numbers = spark.createDataFrame([(whole(p), i) for i, p in files], "of string, file_idx int")  # a row for each file that was named
    df = spark.read.option("lineSep", "\n").text([p for _, p in files])
    # local paths are written with one slash or three
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/")
    df = df.select("value", F.col("_metadata.file_block_start").cast("bigint").alias("block_start"), path.alias("of"))
    df = df.withColumn("row_id", F.monotonically_increasing_id()).join(F.broadcast(numbers), "of")
    return df.select("file_idx", "block_start", "row_id", "value")


def archive(spark: SparkSession, path: str, file_idx: int = 0) -> DataFrame:
    """Lines of a zstd file under a name that Spark doesn't know; skippable frames are passed over.

    Under a local path the seek table gives the splits (``seekable``). From another store Spark's
    binary source hands over the whole file, of up to 2 GB, to one task, which decodes in a stream.
    """
    if seekable.local(path) is not None:
        df = seekable.read(spark, path)
        return _numbered(df.select(F.col("value").cast("string").alias("value"), "block_start"), file_idx, F.col("block_start"))

    def lines(batches):
        import pyarrow as pa

        for batch in batches:
            for data in batch.column(0).to_pylist():
                part: list[bytes] = []
                size = 0
                for line in zstd_lines(data):
                    part.append(line)
                    size += len(line)
                    if size > _CHUNK:
                        yield pa.RecordBatch.from_pydict({"value": pa.array(part, pa.binary())})
                        part, size = [], 0
                if part:
                    yield pa.RecordBatch.from_pydict({"value": pa.array(part, pa.binary())})

    raw = spark.read.format("binaryFile").load(path).select("content").mapInArrow(lines, "value binary")
    return _numbered(raw.select(F.col("value").cast("string").alias("value")), file_idx, F.lit(0))


def zstd_lines(data: bytes) -> Iterator[bytes]:
    """Lines of all frames of a zstd file."""
    import io

    import zstandard

    rest = b""
    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True) as stream:
        while block := stream.read(_CHUNK):
            *whole, rest = (rest + block).split(b"\n")
            yield from whole
    if rest:
        yield rest


def held(spark: SparkSession, part: list[str], file_idx: int = 0) -> DataFrame:
    """Lines that the driver holds, however many they are."""
    return _numbered(_frame(spark, part), file_idx, F.lit(0))


def _frame(spark: SparkSession, part: list[str]) -> DataFrame:
    """``value`` in the order of the lines, many of them as Arrow batches.

    The batches are rows of an RDD: over a local relation the optimizer would run filters itself, in one thread.
    """
    import pyarrow as pa

    few = lambda: spark.createDataFrame([(t,) for t in part], "value string")
    if len(part) < _PIECE:
        return few()
    ends, size = [0], 0
    for i, line in enumerate(part, 1):
        size += len(line)
        if i - ends[-1] >= _PIECE or size >= _CHUNK or i == len(part):
            ends.append(i)
            size = 0
    try:
        pieces = [pa.RecordBatch.from_pydict({"value": pa.array(part[i:j], pa.string())}) for i, j in pairwise(ends)]
    except UnicodeEncodeError:  # half of a surrogate pair, which Arrow has no text for
        return few()

    def sent(batch) -> bytes:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, batch.schema) as to:
            to.write_batch(batch)
        return out.getvalue().to_pybytes()

    def received(batches):
        import pyarrow as pa

        for batch in batches:
            for data in batch.column(0).to_pylist():
                yield from pa.ipc.open_stream(data)

    rows = spark.sparkContext.parallelize([(sent(x),) for x in pieces], len(pieces))
    return spark.createDataFrame(rows, "piece binary").mapInArrow(received, "value string")


def lines(spark: SparkSession, texts: Iterable[str] | DataFrame, file_idx: int = 0) -> DataFrame:
    """What stands for standard input: an iterable of lines, or a DataFrame with a string column ``value``.

    An iterable longer than ``SPOOL`` lines is written to the scratch folder part by part, so the
    driver never holds more.
    """
    if isinstance(texts, DataFrame):
        return _numbered(texts.select("value"), file_idx, F.lit(0))
    texts = iter(texts)
    part = list(islice(texts, SPOOL))
    if len(part) < SPOOL:
        return held(spark, part, file_idx)
    path, n = scratch.folder(spark, "input"), 0
    while part:
        rows = _frame(spark, part).withColumn("row_id", F.monotonically_increasing_id())
        rows.withColumn("block_start", F.lit(n).cast("bigint")).write.mode("append").parquet(path)
        part, n = list(islice(texts, SPOOL)), n + 1
    return spark.read.parquet(path).orderBy("block_start", "row_id").select(F.lit(file_idx).alias("file_idx"), "block_start", "row_id", "value")


def read_all(spark: SparkSession, files: list[str], stdin: Iterable[str] | DataFrame | None = None) -> DataFrame:
    """All inputs in order; ``-`` stands for ``stdin`` in its place. Many plain files are one scan, others a branch each."""
    files = files or ["-"]
    plain = [(i, f) for i, f in enumerate(files) if f != "-" and not f.endswith((*OTHER_ARCHIVES, TABLE)) and files.count(f) == 1 and not _many_in(spark, f)] if len(files) >= MANY else []
    numbers = {i for i, _ in plain}
    rest = [(i, f) for i, f in enumerate(files) if i not in numbers]
    parts = [lines(spark, stdin if stdin is not None else [], i) if f == "-" else text_file(spark, f, i) for i, f in rest]
    parts = ([text_files(spark, plain)] if plain else []) + parts
    if not all("ts_ns" in p.columns for p in parts):  # times are known for all lines or found anew
        parts = [p.drop("ts_ns") for p in parts]
    return reduce(DataFrame.unionByName, parts)


def in_order(files: list[str]) -> bool:
    """Whether a scan gives the lines in their order; a table, or many files in one scan, has them in another."""
    return len(files) < MANY and not any(f.endswith(TABLE) for f in files)


def _many_in(spark: SparkSession, path: str) -> bool:
    """Whether the path names a folder or several files."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return not fs.exists(at) or fs.getFileStatus(at).isDirectory()


def with_raw(df: DataFrame) -> DataFrame:
    """Valid lines only, as ``raw``, without the carriage returns at their ends, which are ``cr``."""
    df = df.where(F.is_valid_utf8("value"))
    return df.withColumn("raw", line_of(F.col("value"))).withColumn("cr", F.regexp_extract("value", r"\r+(?=\n*\z)", 0)).drop("value")


def parsed(df: DataFrame, times: bool = True) -> DataFrame:
    """Adds ``pairs``, ``overflow`` and ``ts_ns``; what a query doesn't use, Catalyst prunes. Times of a table that was ingested are kept."""
    df = df.withColumn("pairs", pairs(F.col("raw"))).withColumn("overflow", overflow(F.col("raw")))
    if not times or "ts_ns" in df.columns:
        return df
    return df.withColumn("ts_ns", time_of(F.col("raw")))


def ingest(df: DataFrame, path: str, files: int = 0) -> None:
    """Writes lines as Parquet in order of time, so that row group statistics prune time slices.

    A ``path`` that ends in ``.lines`` is an input as any other: it keeps the order of its lines.
    """
    n = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(*ORDER, F.concat("raw", "cr").alias("value"), "ts_ns") if "cr" in df.columns else df.select(*ORDER, F.col("raw").alias("value"), "ts_ns")
    rows.repartitionByRange(n, F.col("ts_ns").asc_nulls_first()).sortWithinPartitions("ts_ns", *ORDER).write.parquet(path)


def generated(spark: SparkSession, n: int, start_ns: int = 1_767_225_600_000_000_000, step_ns: int = 1_000_000, seed: int = 42) -> DataFrame:
    """A synthetic log of ``n`` lines as ``value``, made on the executors: time, level and msg, the last quoted."""
    from ..functions.times import format_ns

    r = F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(10_000))
    level = F.when(r < 100, "critical").otherwise(F.element_at(F.array(*map(F.lit, ("debug", "info", "warn", "error"))), (r % 4 + 1).cast("int")))
    time = format_ns(F.lit(start_ns) + F.col("id") * step_ns)
    return spark.range(n).select(F.concat(F.lit("time="), time, F.lit(" level="), level, F.lit(' msg="request '), F.col("id").cast("string"), F.lit(' done"')).alias("value"))
