"""Best-fit packing by non-negative least squares over length patterns.

Documents become token sequences that end with the separator id; those over ``length``
tokens are cut into full pieces after a first, shorter one. Full pieces are sequences of
their own. The histogram of the other lengths, a table of at most ``length`` counts
whatever the corpus, goes to the driver, which plans on counts only: it enumerates patterns
of up to ``DEPTH`` documents whose binned lengths fill a sequence, fits their repeats to
the histogram by non-negative least squares, rounds them down to what is there, and packs
what is left, into room that is left too, by best fit in order of falling length. The
plan, slots by length and rank, is joined to the documents' ranks within their lengths.

Edge cases: a null text is empty and, as an empty one, the separator alone; texts of any
length are cut, never shortened, and long runs of white space are tokenized by the library
itself; repeated rows are packed as often as they come; ties
of length go by id; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import before, written

LENGTH, SEPARATOR = 2048, 0
#: Documents in a pattern at most, and tokens in a bin of lengths.
DEPTH, BIN = 3, 8
#: Documents that share a group when they are ranked within their length, about.
GROUP_ROWS = 50_000


# ---------------------------------------------------------------- tokens


#: White space in a row that the fast path doesn't take: its regular expressions backtrack over all of it.
RUN = 100_000
_RUN = re.compile(r"\s{%d}" % RUN)


def plain_byte_bpe(spec: dict) -> bool:
    """Whether a tokenizer file is byte-level BPE with the usual split and nothing else, its merges in the order of their ids."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    usual = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    extra = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    if spec.get("normalizer") or not usual or model.get("type") != "BPE" or any(model.get(k) for k in extra):
        return False
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ids = [model["vocab"].get(a + b, -1) for a, b in pairs]
    return all(a < b for a, b in zip([-1, *ids], ids))


@lru_cache(maxsize=2)
def encoder(path: str):
    """Text to ids as the tokenizers library gives them for this file.

    If the file is plain byte-level BPE the merges run in tiktoken, on ranks read from the
    same file, about five times as fast. A text that holds a special token's string, or a
    very long run of white space, goes to the library itself, as does every text if the
    file is of another kind.
    """
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if not plain_byte_bpe(spec):
        return lambda text: slow.encode(text, add_special_tokens=False).ids
    special = {t["content"] for t in spec.get("added_tokens", [])}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if any(s in text for s in special) or len(text) >= RUN and _RUN.search(text):
            return slow.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def bounds(total: int, length: int = LENGTH) -> list[int]:
    """Starts of a document's pieces, and its end."""
    first = total % length or length
    return [0, *range(first, total + 1, length)]


def tokenized(docs: DataFrame, tokenizer: str, length: int = LENGTH, separator: int = SEPARATOR) -> DataFrame:
    """doc_id, total (ids with the separator) and the CRC-32 of each piece's ids."""

    def run(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            totals, sums = [], []
            for text in batch.column(1).to_pylist():
                ids = encode(text or "")
                ids.append(separator)
                raw = memoryview(np.array(ids, "<u4").tobytes())
                at = bounds(len(ids), length)
                totals.append(len(ids))
                sums.append([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at, at[1:])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], ["doc_id", "total", "sums"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, total long, sums array<long>")


# ---------------------------------------------------------------- plan on counts


def patterns(bins: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Falling tuples of up to ``depth`` (at most 3) bin numbers whose sum is ``bins``."""
    out: list[tuple[int, ...]] = [(bins,)]
    if depth > 1:
        out += [(a, bins - a) for a in range(bins - 1, (bins - 1) // 2, -1) if bins - a <= a]
    if depth > 2:
        out += [(a, b, bins - a - b) for a in range(bins - 2, 0, -1) for b in range(min(a, bins - a - 1), 0, -1) if bins - a - b <= b]
    return out


def nnls(a: np.ndarray, b: np.ndarray, most: int | None = None) -> np.ndarray:
    """Least squares under x >= 0 by Lawson and Hanson's active sets, on the normal equations."""
    target = a.T @ b
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(most or 3 * a.shape[0]):
        slope = target - a.T @ (a[:, passive] @ x[passive])
        slope[passive] = -np.inf
        if not len(slope) or slope.max() <= tolerance:
            break
        passive[slope.argmax()] = True
        while True:
            on = np.flatnonzero(passive)
            part = a[:, on]
            s = np.linalg.lstsq(part.T @ part, target[on], rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[on] = s
                break
            low = on[s <= 0]
            step = (x[low] / np.maximum(x[low] - s[s <= 0], 1e-300)).min()
            x[on] += step * (s - x[on])
            drop = passive & (x <= 1e-12)
            if not drop.any():
                drop[low] = True
            x[drop] = 0
            passive &= ~drop
            if not passive.any():
                break
    return x


class Plan:
    """Classes of equal sequences: their number and lengths in order."""

    def __init__(self) -> None:
        self.classes: list[tuple[int, tuple[int, ...]]] = []

    def slots(self) -> list[tuple[int, int, int, int, int]]:
        """(length, from rank, to rank, sequence of the first, offset)."""
        used: dict[int, int] = {}
        out, base = [], 0
        for n, lengths in self.classes:
            at = 0
            for x in lengths:
                start = used.get(x, 0)
                out.append((x, start, start + n, base, at))
                used[x] = start + n
                at += x
            base += n
        return out

    @property
    def sequences(self) -> int:
        return sum(n for n, _ in self.classes)


def plan(histogram: dict[int, int], length: int = LENGTH, width: int = BIN, depth: int = DEPTH) -> Plan:
    """Packs ``histogram`` (length to count) into sequences of ``length``; works on counts only."""
    left = np.zeros(length + 1, np.int64)
    for x, n in histogram.items():
        left[x] = n
    bins = length // width
    of_bin = -(-np.arange(length + 1) // width)
    counts = np.bincount(of_bin, left, bins + 1)[1:]
    shapes = patterns(bins, depth)
    matrix = np.zeros((bins, len(shapes)))
    for j, shape in enumerate(shapes):
        for b in shape:
            matrix[b - 1, j] += 1
    # rows weigh by the room that a wrong count wastes: long documents are the hard ones
    scale = np.sqrt(np.arange(1, bins + 1) / bins)[:, None]
    repeats = nnls(matrix * scale, counts * scale[:, 0]) if counts.sum() else np.zeros(len(shapes))
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = {}

    def put(room: int, n: int, lengths: tuple[int, ...]) -> None:
        open_.setdefault(room, []).append((n, lengths))

    avail = counts.astype(np.int64)
    runs = {b: [x for x in range((b - 1) * width + 1, b * width + 1)] for b in range(1, bins + 1)}
    for j in np.argsort(-repeats):
        shape, want = shapes[j], int(round(repeats[j]))
        for b in set(shape):
            want = min(want, int(avail[b - 1]) // shape.count(b))
        if want <= 0:
            continue
        for b in shape:
            avail[b - 1] -= want
        # the longest of the first bin meet the shortest of the others, so that sums stay even
        parts = []
        for k, b in enumerate(shape):
            need, got = want, []
            for x in sorted(runs[b], reverse=not k):
                n = min(need, int(left[x]))
                if n:
                    left[x] -= n
                    need -= n
                    got.append([x, n])
            parts.append(got)
        while parts[0]:
            n = min(p[0][1] for p in parts)
            lengths = tuple(p[0][0] for p in parts)
            put(length - sum(lengths), n, lengths)
            for p in parts:
                p[0][1] -= n
                if not p[0][1]:
                    p.pop(0)
    # best fit, in order of falling length, of what is left
    for x in range(length, 0, -1):
        n = int(left[x])
        while n:
            room = min((r for r in open_ if r >= x), default=None)
            if room is None:
                each = length // x
                if n >= each:
                    put(length - each * x, n // each, (x,) * each)
                    n %= each
                else:
                    put(length - n * x, 1, (x,) * n)
                    n = 0
                continue
            have, lengths = open_[room].pop()
            if not open_[room]:
                del open_[room]
            take = min(have, n)
            put(room - x, take, (*lengths, x))
            if have > take:
                put(room, have - take, lengths)
            n -= take
    out = Plan()
    out.classes = [c for room in sorted(open_) for c in open_[room]]
    return out


# ---------------------------------------------------------------- assignment


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, separator: int = SEPARATOR) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    rows = written(tokenized(docs, tokenizer, length, separator), "tokens")
    n = rows.count()
    groups = max(1, -(-n // GROUP_ROWS))
    first, full = (F.col("total") % length).cast("int"), F.floor(F.col("total") / length).cast("long")
    rows = rows.select("doc_id", "total", "sums", first.alias("rest"), full.alias("full"), F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("salt"))
    histogram = dict(rows.where("rest > 0").groupBy("rest").count().collect())  # at most length - 1 rows
    packed = plan(histogram, length)

    # ranks within a length, and numbers of full pieces, group by group
    parts = before(rows.groupBy("rest", "salt").agg(F.count(F.lit(1)).alias("n")), ["rest"], "salt", "n").withColumnRenamed("before", "rank_base")
    fulls = rows.groupBy("salt").agg(F.sum("full").alias("n")).withColumn("all", F.lit(0))
    fulls = before(fulls, ["all"], "salt", "n").select("salt", F.col("before").alias("full_base"))
    by = Window.partitionBy("salt").orderBy("rest", "doc_id", "total")
    earlier = F.coalesce(F.sum("full").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("salt", "rest").orderBy("doc_id", "total")) - 1
    rows = rows.withColumn("earlier", earlier).withColumn("within", within)
    rows = rows.join(parts, ["rest", "salt"]).join(fulls, "salt")
    rows = rows.withColumn("rank", F.col("rank_base") + F.col("within")).withColumn("full_from", F.col("full_base") + F.col("earlier") + packed.sequences)

    # a row for each slot of a class: their number depends on the lengths, not on the corpus
    slots = spark.createDataFrame(packed.slots() or [(0, 0, 0, 0, 0)], "slot_rest int, slot_from long, slot_to long, slot_sequence long, slot_offset long")
    fits = (F.col("rest") == F.col("slot_rest")) & (F.col("rank") >= F.col("slot_from")) & (F.col("rank") < F.col("slot_to"))
    rows = rows.join(slots, fits, "left")
    rows = rows.select("doc_id", "rest", "rank", "full_from", "slot_from", "slot_sequence", "slot_offset", F.posexplode("sums").alias("piece", "ids_crc32"))
    short = (F.col("rest") > 0) & (F.col("piece") == 0)
    lead = (F.col("rest") > 0).cast("int")
    return rows.select(
        "doc_id",
        F.col("piece").cast("int").alias("piece"),
        F.when(short | (F.col("piece") == 0), 0).otherwise(F.col("rest") + (F.col("piece") - lead) * length).cast("long").alias("start"),
        F.when(short, F.col("rest")).otherwise(length).cast("long").alias("length"),
        "ids_crc32",
        F.when(short, F.col("slot_sequence") + F.col("rank") - F.col("slot_from")).otherwise(F.col("full_from") + F.col("piece") - lead).cast("long").alias("sequence_id"),
        F.when(short, F.col("slot_offset")).otherwise(0).cast("long").alias("offset"),
    )
