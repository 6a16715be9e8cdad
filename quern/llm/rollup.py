"""Token counts kept by deltas.

``TokenRollup`` holds additive totals by source, language and tokenizer version as a
folder of batches. A batch is a set of changes: inserts (+), deletes (-) and revised
counts (minus the old, plus the new). It is summed by key before it is written.

Commits are idempotent. Each commit of a batch writes a folder of its own, ``batch=<id>/try=<n>``;
readers take the last try that is whole, so a commit that dies leaves the one before in
place, and a batch committed again counts once. ``compact`` writes the totals as
``base=<n>`` and then, in one atomic step, its manifest, which names the batches that it
absorbed. Readers take the last base that has a manifest and pass over what it absorbed,
whether that has been deleted yet or not; a commit of an absorbed batch changes nothing.
One compaction runs at a time; a reader that began before one may have to begin again.

Edge cases: null sources, languages and versions are groups of their own; null counts
are 0; a null text has no tokens; an empty one neither; a text of any length is counted by
one expression in the JVM; repeated rows are counted as often as they come; ties don't
arise, as nothing is ordered; an empty batch, or an empty table, leaves the totals as they
are; keys whose documents and tokens cancel out disappear; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, new_dir, table, text_of, written

KEYS = ["source", "lang", "tokenizer"]
_TOTALS = ["docs", "tokens"]


def changes(docs: DataFrame, tokenizer: str, tokens: Column, sign: int = 1) -> DataFrame:
    """Changes that insert (sign 1) or delete (-1) documents."""
    return docs.select(
        F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(tokenizer).alias("tokenizer"),
        F.lit(sign).cast("long").alias("docs"), (F.coalesce(tokens, F.lit(0)).cast("long") * sign).alias("tokens"),
    )


def revisions(docs: DataFrame, tokenizer: str, old: Column, new: Column) -> DataFrame:
    """Changes that revise the token counts of documents that stay."""
    diff = F.coalesce(new, F.lit(0)).cast("long") - F.coalesce(old, F.lit(0)).cast("long")
    return changes(docs, tokenizer, diff).withColumn("docs", F.lit(0).cast("long"))


class TokenRollup:
    """Totals under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _at(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))

    def _fs(self):
        return self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self, prefix: str, *names: str) -> list[str]:
        """What follows ``prefix`` in the names of the folders there."""
        fs, where = self._fs(), self._at(*names)
        found = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        return [name.removeprefix(prefix) for name in found if name.startswith(prefix)]

    def _state(self) -> tuple[int, dict, dict[str, str]]:
        """Number and manifest of the last whole base, and of each batch outside it the last whole try."""
        fs = self._fs()
        base = max((n for n in map(int, self._numbers("base=")) if fs.exists(self._at(f"base={n}", "manifest"))), default=0)
        manifest = {"id": None, "absorbed": []}
        if base:
            file = fs.open(self._at(f"base={base}", "manifest"))
            manifest = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8"))
            file.close()
        live = {}
        for b in set(self._numbers("batch=")) - set(manifest["absorbed"]):
            tries = [n for n in map(int, self._numbers("try=", f"batch={b}")) if fs.exists(self._at(f"batch={b}", f"try={n}", "_SUCCESS"))]
            if tries:
                live[b] = f"{self.path}/batch={b}/try={max(tries)}"
        return base, manifest, live

    def batches(self) -> list[str]:
        """Ids of the batches that readers add up, that of the last compaction among them."""
        _, manifest, live = self._state()
        return sorted([*live, *([manifest["id"]] if manifest["id"] is not None else [])])

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Adds the deltas as this batch; to commit an id again replaces what it held. False if a compaction has absorbed it already."""
        _, manifest, live = self._state()
        if batch_id == manifest["id"]:
            raise ValueError(f"batch {batch_id} is a compaction")
        if batch_id in manifest["absorbed"]:
            return False
        older = list(map(int, self._numbers("try=", f"batch={batch_id}")))
        summed = deltas.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in _TOTALS))
        summed.write.parquet(f"{self.path}/batch={batch_id}/try={max(older, default=0) + 1}")
        self._drop(*((f"batch={batch_id}", f"try={n}") for n in older))
        return True

    def totals(self) -> DataFrame:
        return self._totals(*self._state())

    def _totals(self, base: int, manifest: dict, live: dict[str, str]) -> DataFrame:
        paths = [*live.values(), *([f"{self.path}/base={base}/data"] if base else [])]
        schema = "source string, lang string, tokenizer string, docs long, tokens long"
        if not paths:
            return self.spark.createDataFrame([], schema)
        every = self.spark.read.schema(schema).parquet(*paths)
        return every.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in _TOTALS)).where("docs <> 0 or tokens <> 0")

    def compact(self, batch_id: str) -> None:
        """Folds all batches into one that is called ``batch_id``."""
        base, manifest, live = self._state()
        if batch_id in live or batch_id == manifest["id"] or batch_id in manifest["absorbed"]:
            raise ValueError(f"batch {batch_id} is there already")
        n = max(map(int, self._numbers("base=")), default=0) + 1
        self._totals(base, manifest, live).write.parquet(f"{self.path}/base={n}/data")
        ids = {*manifest["absorbed"], *live, *([manifest["id"]] if base else [])}
        self._publish(n, {"id": batch_id, "absorbed": sorted(ids)})
        self._drop(*((f"batch={b}",) for b in live), *((f"base={k}",) for k in map(int, self._numbers("base=")) if k != n))

    def _publish(self, n: int, manifest: dict) -> None:
        fs, part = self._fs(), self._at(f"base={n}", ".manifest")
        file = fs.create(part, True)
        file.write(bytearray(json.dumps(manifest).encode()))
        file.close()
        fs.rename(part, self._at(f"base={n}", "manifest"))

    def _drop(self, *folders: tuple[str, ...]) -> None:
        """Deletes what nobody reads any more."""
        fs = self._fs()
        for names in folders:
            fs.delete(self._at(*names), True)


def words_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def runs_of(text: Column) -> Column:
    """Tokens of version 2: runs of letters or digits, and every other character that isn't white space."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")).cast("long")


def count_corpus(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Three batches over ``documents``: all inserted under ``words-1``; those of under 50 words
    deleted again; all inserted under ``runs-2``, whose first count, characters, is then revised.
    The deletes are committed twice, as after a retry."""
    docs = table(spark, sf_dir, "documents")
    text = text_of(docs)
    counted = docs.select("source", "lang", words_of(text).alias("words"), runs_of(text).alias("runs"), F.char_length(text).alias("chars"))
    counted = written(counted, "counted")  # five numbers a row: texts are read once, not once a batch
    rollup = TokenRollup(spark, path or new_dir(spark, "rollup"))
    rollup.commit("0001-insert", changes(counted, "words-1", F.col("words")).unionByName(changes(counted, "runs-2", F.col("chars"))))
    for _ in range(2):
        rollup.commit("0002-delete", changes(counted.where("words < 50"), "words-1", F.col("words"), -1))
    rollup.commit("0003-revise", revisions(counted, "runs-2", F.col("chars"), F.col("runs")))
    return rollup.totals()
