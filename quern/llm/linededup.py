"""Line dedup: repeated windows of three consecutive lines.

Lines are trimmed and blank ones passed over; every three in a row are a window, with
the hash of its lines. A window's first occurrence, by ``doc_id`` and then position, stays;
the lines that its later occurrences cover go, where covered positions merge. A later
occurrence that overlaps the first in the same document leaves the lines of the first.

Only hashes and positions are shuffled to find the repeats, pre-aggregated by window, so
a window that a third of the documents share is a count and a minimum on each task. They are
written once, as both the search for first occurrences and that for later ones read them.

Edge cases: a null text stays null and an empty one empty; a document of fewer than three
lines has no window; texts of any length are read whole; repeated rows (same id and text)
count as one document and are treated alike; among rows of one id with different texts the
occurrence whose row hashes lowest is first; a null id comes first; an empty table gives an
empty result. Other columns, whatever their names, pass through, but for ``n_lines`` and
``removed_lines``, which are replaced.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aside, written

LINES = 3
#: What is trimmed: the white space of Java's ``\\s``.
_WHITE = " \t\n\x0b\f\r"


def _numbered(text):
    """The lines that are not blank, trimmed."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))
    return F.filter(lines, lambda x: x != "")


def line_windows(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """doc_id, row (a hash of id and text), p (number of the window's first line that isn't blank), h."""
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("doc_id", "text").alias("row"), _numbered(F.col("text")).alias("_x"))
    rows = rows.where(F.size("_x") >= lines)
    hashes = F.transform(F.sequence(F.lit(1), F.size("_x") - (lines - 1)), lambda p: F.xxhash64(*(F.element_at("_x", p + F.lit(k)) for k in range(lines))))
    return rows.select("doc_id", "row", F.posexplode(hashes).alias("p", "h"))


def repeated(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """doc_id, row and the sorted covered positions of the documents that lose lines."""
    windows = written(line_windows(docs, lines), "windows")
    place = F.struct("doc_id", "row", "p")
    first = windows.groupBy("h").agg(F.min(place).alias("f"), F.max(place).alias("l")).where(~F.col("f").eqNullSafe(F.col("l"))).select("h", "f")
    later = windows.join(first, "h").where(~place.eqNullSafe(F.col("f")))
    same = F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("row") == F.col("f.row"))
    start = F.when(same, F.greatest("p", F.col("f.p") + lines)).otherwise(F.col("p"))
    later = later.select("doc_id", "row", start.alias("a"), (F.col("p") + lines - 1).alias("b")).where("a <= b")
    spans = later.groupBy("doc_id", "row").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["a"], s["b"])))))
    return spans.select("doc_id", "row", covered.alias("covered"))


def without(texts: pa.Array, covered: pa.Array) -> pa.Array:
    """Each text without its covered lines, by their numbers among the lines that aren't blank."""
    out = []
    for text, gone in zip(texts.to_pylist(), covered.to_pylist()):
        if text is None or gone is None:
            out.append(text)
            continue
        drop, kept, n = set(gone), [], 0
        for line in text.split("\n"):
            blank = not line.strip(_WHITE)
            if blank or n not in drop:
                kept.append(line)
            n += not blank
        out.append("\n".join(kept))
    return pa.array(out, pa.string())


def dedup_lines(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """The documents without later occurrences; n_lines and removed_lines count lines that aren't blank."""
    gone = repeated(docs, lines).select(F.col("doc_id").alias("gone_id"), F.col("row").alias("gone_row"), "covered")
    docs = docs.drop("n_lines", "removed_lines")
    rows, own = aside(docs, "gone_id", "gone_row", "covered", "row")
    rows = rows.withColumn("row", F.xxhash64("doc_id", "text"))
    rows = rows.join(gone, (F.col("row") == F.col("gone_row")) & F.col("doc_id").eqNullSafe(F.col("gone_id")), "left")
    cut = F.arrow_udf(without, "string")  # sees the texts that lose lines, and nulls for the others
    hit = F.col("covered").isNotNull()
    return rows.select(
        *(column for name, column in zip(docs.columns, own) if name != "text"),
        F.coalesce(cut(F.when(hit, F.col("text")), F.col("covered")), F.col("text")).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(_numbered(F.col("text")))).alias("n_lines"),
        F.when(hit, F.size("covered")).otherwise(0).alias("removed_lines"),
    )
