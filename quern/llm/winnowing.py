"""Winnowing fingerprints by DataFrame functions only.

The words of a text (lower-cased) are hashed once each; every ``k`` in a row have the value
of a rolling hash, a polynomial in ``BASE`` over their hashes modulo ``PRIME``. Of every ``w``
values in a row the least is chosen, on ties the rightmost. Any two texts that share
``w + k - 1`` words in a row share a chosen value. A chosen value keeps its position: value
and reversed position are packed in one long, ``value << 28 | (2**28 - 1 - position)``,
whose minimum is the least value at its rightmost place.

A running state would be copied at every step of ``aggregate``; instead the values of all
positions, and the minima of all windows, come by doubling: those of 2n words from two of n.
Each is a fixed number of array passes, as much work for a position as rolling, with the same values.

Edge cases: a null text is empty; a text without words has no chosen value, one of fewer
than ``k`` words has one over all of them, one of fewer than ``w`` values their least; texts
of up to 2**28 words keep exact positions; two empty fingerprints are alike (1.0), an empty
and another are not (0.0); rows of one id, repeated ones among them, are in order of their
texts, as are those of null ids, which are last; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, partitions, text_of

K, W = 4, 8
#: The modulus, a prime, and the base of the polynomial; the product of a value and base**2 fits a long.
PRIME, BASE = 2**35 - 31, 8191
_PLACE = 28
_LAST = (1 << _PLACE) - 1
#: Documents that share a range of ids, about, when each is given its neighbour.
RANGE_ROWS = 2_000
#: Ranges up to which a row of two numbers for each is broadcast, in a block of which neighbours are found, and in a partition.
SENT, BLOCK, TOGETHER = 100_000, 4_096, 8


def bound(value: Column, use) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def winnow(text: Column, k: int = K, w: int = W) -> Column:
    """Packed chosen values, by position."""
    none = F.array().cast("array<bigint>")
    word_hashes = lambda t: F.transform(F.regexp_extract_all(F.lower(t), F.lit(WORD), F.lit(0)), lambda x: F.shiftrightunsigned(F.xxhash64(x), 64 - 35) % F.lit(PRIME))
    return bound(word_hashes(text), lambda h: F.when(F.size(h) == 0, none).otherwise(bound(_packed(h, k), lambda v: _minima(v, w))))


def rolled(h: Column, k: int) -> Column:
    """Of each position the value of its ``k`` hashes: h[i] * BASE**(k-1) + ... + h[i+k-1], modulo PRIME. ``h`` has ``k`` or more."""
    out, n = h, 1
    for bit in bin(k)[3:]:
        out = _with_later(out, out, n, lambda a, b: (_times(a, n) + b) % F.lit(PRIME))
        n *= 2
        if bit == "1":
            out = _with_later(out, h, n, lambda a, b: (_times(a, 1) + b) % F.lit(PRIME))
            n += 1
    return F.slice(out, 1, F.size(h) - (k - 1))  # what zip_with pads with nulls is behind that


def _with_later(a: Column, b: Column, n: int, use) -> Column:
    """``use`` of each element of ``a`` and the one ``n`` places later in ``b``."""
    if a is b:
        return bound(a, lambda x: F.zip_with(x, F.slice(x, n + 1, F.size(x)), use))
    return F.zip_with(a, F.slice(b, n + 1, F.size(b)), use)


def _times(x: Column, n: int) -> Column:
    """x * BASE**n modulo PRIME, in steps that fit a long."""
    while n > 0:
        x = x * F.lit(BASE ** min(n, 2)) % F.lit(PRIME)
        n -= 2
    return x


def _packed(h: Column, k: int) -> Column:
    """Values of all positions over their places; of fewer than ``k`` words one, as if zeros followed."""
    full = F.concat(h, F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(k) - F.size(h), F.lit(0))))
    return F.transform(bound(full, lambda x: rolled(x, k)), lambda v, i: v * F.lit(1 << _PLACE) + (F.lit(_LAST) - i))


def _minima(v: Column, w: int) -> Column:
    """The distinct minima of ``w`` in a row; least() passes over the nulls behind the end."""
    out, n = v, 1
    while n < w:
        step = min(n, w - n)
        out = _with_later(out, out, step, lambda a, b: F.least(a, b))
        n += step
    return F.array_distinct(F.slice(out, 1, F.greatest(F.size(v) - (w - 1), F.lit(1))))


def hashes(chosen: Column) -> Column:
    """The distinct chosen values, without their positions."""
    return F.array_distinct(F.transform(chosen, lambda c: F.shiftrightunsigned(c, _PLACE)))


def positions(chosen: Column) -> Column:
    """Number of the first word of each chosen value."""
    return F.transform(chosen, lambda c: F.lit(_LAST) - c.bitwiseAND(F.lit(_LAST)))


def digest(chosen: Column) -> Column:
    """Number of chosen values, and a digest over them and their positions."""
    return F.concat(F.size(chosen).cast("string"), F.lit(":"), F.md5(F.array_join(F.transform(chosen, lambda c: F.hex(c)), ",")))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / F.greatest(either, F.lit(1)))


def _ranges(docs: DataFrame, group_rows: int) -> tuple[Column, int]:
    """Number of the id range of a row (higher ids, higher numbers; null ids are last at -1), and how many there are at most.

    Up to 10,000 quantiles of the ids are literals; beyond so many ranges, each stretch
    between two quantiles is cut evenly.
    """
    ids = docs.select(F.col("doc_id").cast("double").alias("x")).where("x is not null")
    low, high, count = ids.agg(F.min("x"), F.max("x"), F.count("x")).first()
    if not count:
        return F.lit(-1).cast("long"), 1
    ranges = -(-count // group_rows)
    parts = min(ranges, 10_000)
    cuts = sorted({low, *(ids.approxQuantile("x", [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else [])})
    fine = -(-ranges // parts)
    x, bounds, ends = F.col("doc_id").cast("double"), F.array(*map(F.lit, cuts)), F.array(*map(F.lit, [*cuts[1:], high + 1]))
    steps = F.array(*(F.lit(1 << b) for b in range(len(cuts).bit_length() - 1, -1, -1)))
    reached = lambda n: F.coalesce(F.get(bounds, n - 1) <= x, F.lit(False))
    n = F.aggregate(steps, F.lit(0), lambda n, step: F.when(reached(n + step), n + step).otherwise(n))
    place = F.transform(F.array(n - 1), lambda k: k * fine + F.least(F.lit(fine - 1), F.floor((x - F.get(bounds, k)) / (F.get(ends, k) - F.get(bounds, k)) * fine).cast("int")))[0]
    return F.when(x.isNull(), F.lit(-1)).otherwise(place).cast("long"), len(cuts) * fine + 1


def with_next(docs: DataFrame, group_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, text, chosen, next_text, next_chosen: with the next document by descending id.

    After the last comes the first; rows of one id are in order of their texts. A window
    within a range of ids finds the neighbour; each range also gets, as a guest, the
    first document of the next range that has rows, so texts are shuffled once.
    """
    number, ranges = _ranges(docs, group_rows)
    rows = docs.select(number.alias("range"), "doc_id", text_of(docs).alias("text"), F.lit(0).alias("guest"))
    heads = docs.select(number.alias("range"), "doc_id").groupBy("range").agg(F.max("doc_id").alias("head"))
    heads = _followed(heads).select(F.col("range").alias("of"), "head")
    if ranges <= SENT:  # a row for each range: of a checked size
        heads = F.broadcast(heads)
    guests = docs.select(F.col("doc_id").alias("id"), text_of(docs).alias("t")).join(heads, F.col("id").eqNullSafe(F.col("head")))
    guests = guests.groupBy("of", "head").agg(F.min("t").alias("t"))
    rows = rows.unionByName(guests.select(F.col("of").alias("range"), F.col("head").alias("doc_id"), F.col("t").alias("text"), F.lit(1).alias("guest")))
    rows = rows.withColumn("chosen", winnow(F.col("text"))).repartition(max(partitions(docs.sparkSession), ranges // TOGETHER), "range")
    order = Window.partitionBy("range").orderBy("guest", F.desc_nulls_last("doc_id"), "text")
    rows = rows.select("doc_id", "text", "chosen", "guest", F.lead("text").over(order).alias("next_text"), F.lead("chosen").over(order).alias("next_chosen"))
    return rows.where("guest = 0").drop("guest")


def _followed(heads: DataFrame) -> DataFrame:
    """(range, head) with the head of the next range by falling number that is there, after the last that of the first.

    Neighbours are found within blocks of ranges, and a row for each block tells what follows
    it. Heads are wrapped, as one may be the null id.
    """
    heads = heads.select("range", F.struct("head").alias("own"), F.floor(F.col("range") / BLOCK).alias("block"))
    inner = Window.partitionBy("block").orderBy(F.desc("range"))
    down = Window.orderBy(F.desc("block"))
    blocks = heads.groupBy("block").agg(F.max_by("own", "range").alias("first"))
    every = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("block", F.coalesce(F.lead("first").over(down), F.first("first").over(every)).alias("after"))
    heads = heads.select("range", "block", F.lead("own").over(inner).alias("next")).join(blocks, "block")
    return heads.select("range", F.coalesce("next", "after")["head"].alias("head"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edit, and how alike they and the next text are.

    The edit: the last third of the code points gives way to the first as many of the next text.
    """
    rows = with_next(docs)
    n, cut = F.char_length("text"), F.floor(F.char_length("text") / 3).cast("int")
    edited = F.concat(F.left("text", n - cut), F.left("next_text", cut))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "chosen", "next_chosen")
    rows = rows.withColumn("edited_chosen", winnow(F.col("edited")))
    rows = rows.withColumn("own", hashes(F.col("chosen")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        digest(F.col("chosen")).alias("fingerprint"),
        digest(F.col("edited_chosen")).alias("edited_fingerprint"),
        likeness(F.col("own"), hashes(F.col("edited_chosen"))).alias("near_edited"),
        likeness(F.col("own"), hashes(F.col("next_chosen"))).alias("near_next"),
    )
