"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws the exponential key ``-ln(u) / quality``; ``u`` comes from a hash
of its id, so reruns agree. Ascending keys within a source are a weighted sample
without replacement. A source's budget is first spent on complete epochs, then on
the documents of least key, by a prefix sum of their sizes; the document at which the
budget ends is taken in part.

Edge cases: a null text has size 0, as an empty one, and is never taken; a text of any length
counts by one expression in the JVM and is never cut; a null source is a source of its own,
the last; a null ``doc_id`` counts as the empty id; ties of keys go by ``doc_id`` and then
size; repeated rows are documents of their own; an empty table gives an empty result. ``mix``
returns columns of its own in place of kept ones of the same names; ``mixed_rows`` returns
the columns it got, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, before, named, text_of, written

#: Rows of all sources that share a range of keys, about.
GROUP_ROWS = 500
_RESULTS = ("doc_id", "size", "source_size", "target", "taken", "copies")


def quality(text):
    """Share of letters among the characters, from 0.1 to 1."""
    letters = F.char_length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.lit(0.1) + F.lit(0.9) * letters / F.greatest(F.char_length(text), F.lit(1))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per document: doc_id, ``keep``, size, source_size, target, taken, copies.

    ``weights`` are dealt to the sources in code point order, null last, again and
    again. All sources share ``share`` times all words; none gets over ``most`` times
    its own, and what it can't take goes to the others by weight. ``taken``: words,
    repeats counted. ``copies``: how often the whole document is taken, to the nearest.
    """
    keep = [c for c in keep if c.lower() not in _RESULTS]
    return _mixed(docs, weights, share, most, seed, keep).select("doc_id", *(F.col("kept")[c].alias(c) for c in keep), *_RESULTS[1:])


def mixed_rows(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """The documents, each as often as the mix takes it (``copies``), with their own columns."""
    mixed = _mixed(docs, weights, share, most, seed, docs.columns)
    return mixed.select("kept", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("kept.*")


def _mixed(docs: DataFrame, weights: Sequence[int], share: float, most: float, seed: str, keep: Sequence[str]) -> DataFrame:
    """The results, beside them ``kept``: the columns ``keep`` as one, so that no name can clash."""
    text = text_of(docs)
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10)
    kept = [F.struct(*map(named, keep)).alias("kept")] if keep else []
    rows = docs.select(
        "doc_id",
        *kept,
        F.col("source").isNull().alias("none"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        quality(text).alias("quality"),
        (-F.log((draw.cast("double") + 0.5) / F.lit(float(2**52)))).alias("draw"),
    )
    rows = written(rows, "mix")  # texts are read once; sums then read numbers only
    n, mean = rows.agg(F.count(F.lit(1)), F.avg("quality")).first()
    ranges = max(1, -(-n // GROUP_ROWS))
    # the share of keys below a key, if all had the mean quality: ranges are about even, and rising with the key in any case
    below = 1 - F.exp(-F.col("key") * F.lit(mean or 1.0))
    rows = rows.withColumn("key", F.col("draw") / F.col("quality")).withColumn("range", F.least(F.lit(ranges - 1), F.floor(below * ranges)).cast("long"))

    key = ["none", "name"]
    parts = rows.groupBy(*key, "range").agg(F.sum("size").alias("words"))
    targets = source_targets(parts.groupBy(*key).agg(F.sum("words").alias("source_size")), weights, share, most)
    parts = before(parts, key, "range", "words").join(targets, key)

    row = Window.partitionBy(*key, "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("earlier", F.coalesce(F.sum("size").over(row), F.lit(0)))
    budget = F.floor("target").cast("long")
    whole = F.greatest(F.col("source_size"), F.lit(1))
    epochs = F.floor(budget / whole).cast("long")
    rest = budget - epochs * whole - F.col("before") - F.col("earlier")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return rows.join(parts, [*key, "range"]).select(
        "doc_id",
        *(["kept"] if keep else []),
        "size",
        "source_size",
        "target",
        (epochs * F.col("size") + extra).alias("taken"),
        (epochs + F.when((extra > 0) & (2 * extra >= F.col("size")), 1).otherwise(0)).cast("int").alias("copies"),
    )


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """Adds ``target``: weighted shares, filled like water up to ``most`` times each size.

    Works on one row per source. With sources in order of the level at which they are
    full, the level that spends the total is the first that its own source can hold.
    """
    order = Window.orderBy("none", "name")
    sizes = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("double"))
    sizes = sizes.withColumn("most", F.col("source_size") * F.lit(float(most))).withColumn("full", F.col("most") / F.col("w"))
    fill = Window.orderBy("full", "none", "name")
    full = F.coalesce(F.sum("most").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing))
    sizes = sizes.withColumn("level", (F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)) - full) / left)
    level = F.min(F.when(F.col("level") <= F.col("full"), F.struct("full", "level"))).over(Window.partitionBy())["level"]
    target = F.least(F.col("most"), F.coalesce(level, F.max("full").over(Window.partitionBy())) * F.col("w"))
    return sizes.select("none", "name", "source_size", target.alias("target"))
