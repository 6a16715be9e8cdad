"""What several operators share: reading tables, written intermediate tables, word hashes.

Intermediate tables go to the folder that ``spark.checkpoint.dir`` names. All
executors and the driver see it, so a lost executor costs a task, not the lineage.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words, as all contracts here define them: runs without space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"

#: Words in a shingle, and the least likeness of near copies in percent.
SHINGLE, LIKENESS = 5, 80


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only where none is named and all runs on this machine, as in tests, one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"

    def forget() -> None:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the JVM may be gone already
            pass

    atexit.register(forget)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and its lineage ends there."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(df: DataFrame, column: str = "text"):
    """The text, with null as the empty text."""
    return F.coalesce(df[column], F.lit(""))


def named(column: str) -> Column:
    """The column of this very name, dots and backticks in it included."""
    return F.col("`" + column.replace("`", "``") + "`")


def aside(df: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """``df`` with columns called like ``names`` (case apart) under other names, and all its columns under their own again."""
    taken = {*map(str.lower, df.columns), *map(str.lower, names)}
    new = []
    for c in df.columns:
        other = c
        if c.lower() in map(str.lower, names):
            while other.lower() in taken:
                other += "_"
            taken.add(other.lower())
        new.append(other)
    return df.toDF(*new), [named(n).alias(c) for n, c in zip(new, df.columns)]


def before(parts: DataFrame, key: list[str], at: str, value: str, fan: int = 1024) -> DataFrame:
    """key, ``at`` and ``before``: the sum of ``value`` over the rows of the key whose number ``at`` is less. By two levels, so
    that no task sees more than the square root of all numbers, about."""
    block = F.floor(F.col(at) / fan).alias("_block")
    rows = parts.select(*key, at, F.col(value).alias("_value"), block)
    up_to = lambda order, *by: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*key, "_block").agg(F.sum("_value").alias("_value"))
    blocks = blocks.select(*key, "_block", F.coalesce(F.sum("_value").over(up_to("_block", *key)), F.lit(0)).alias("_base"))
    inner = F.coalesce(F.sum("_value").over(up_to(at, *key, "_block")), F.lit(0))
    rows = rows.select(*key, "_block", at, inner.alias("_inner")).join(blocks, [*key, "_block"])
    return rows.select(*key, at, (F.col("_base") + F.col("_inner")).alias("before"))


# ---------------------------------------------------------------- words in numpy

_U = np.uint64
_MULT = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(n: int, base: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * _U(pow(base, len(out), 1 << 64))])
    return out[:n]


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _U(_MULT))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
_UP = _powers(1 << 16, _BASE)
_DOWN = _powers(1 << 16, pow(_BASE, -1, 1 << 64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if n > len(_UP):
        _UP, _DOWN = _powers(2 * n, _BASE), _powers(2 * n, pow(_BASE, -1, 1 << 64))
    return _UP[:n], _DOWN[:n]


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a UTF-8 text with A-Z lower-cased, in order."""
    if not text:
        return np.zeros(0, np.uint64)
    a = np.frombuffer(text.lower(), np.uint8)  # bytes.lower() touches A-Z only
    gap = SPACE[a]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(a) + 1)
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * up[: len(a)], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    return mixed(h + (end - start).astype(np.uint64) * _U(_MULT))


def shingle_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles; with fewer words, of the whole sequence as one."""
    n = len(words)
    if not n:
        return words
    width = min(n, size)
    h = np.zeros(n - width + 1, np.uint64)
    for j in range(width):
        h = mixed(h * _U(_BASE) + words[j : n - width + 1 + j])
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]
