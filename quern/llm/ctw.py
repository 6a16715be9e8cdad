"""Language-model scores by context-tree weighting over bytes.

A text (A-Z lower-cased) is its bytes and an end mark; a byte is eight binary choices,
each with its own tree of the preceding ``DEPTH`` bytes. A node's Krichevsky-Trofimov
estimate, from counts over all training texts, is weighed against the product of its
children's weighted estimates, so every prediction mixes all depths. The code length per
byte, ``bits_per_byte``, is ``-score * log2(10) / (n_bytes + 1)``.

Texts are gathered into chunks of ``CHUNK`` bytes. A chunk sends its distinct byte strings
of ``DEPTH + 1``, with their counts in its training texts, to the buckets of the ``TOP``
bytes before the last, and its distinct words to the buckets of their hashes. A bucket adds
up the counts over all chunks and builds every tree from depth ``TOP`` on whole; the nodes
above, of which there are at most 256**TOP + 256**2 + 256 of each of 255 choices (in text a few
hundred thousand), are summed on the executors, packed into arrays and broadcast. Then the
chunks ask: a bucket answers each with the log probabilities of its strings, or the counts of
its words, and the chunk sums the answers over its texts. No node and no word is left out at
any size. A bucket reads the questions as a stream, and a chunk its answers, so a bucket holds
its own distinct strings and a chunk those of its texts. All strings behind three given bytes
are one bucket at most: 256**3 of them at depth 5, whatever the corpus. A chunk asks for a
string or word once, however frequent, so none of them makes a bucket hot. A text longer than
a block is read in pieces, cut behind white space, each with the bytes before it.

A context that the training texts don't have predicts as the next shorter one does.

Edge cases: a null text is empty and has the end alone; without training texts all bits
have probability 1/2; repeated rows are scored and learned from as often as they come; a
null id counts as the empty id; ties don't arise, as nothing is ordered; an empty table gives
an empty result; other columns, whatever their names, are ignored; a text of any length is a
chunk of its own if need be; words are told apart by 64 bits of hash.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import SPACE, mixed, partitions, word_hashes, written

#: Bytes of context, and of those how many deal strings to buckets.
DEPTH, TOP = 5, 3
#: Bytes of text that are turned into strings at once, and in a chunk.
BLOCK, CHUNK = 1 << 19, 8 << 20
#: Keys in a row of totals, questions answered at once, answers that a bucket remembers, and keys merged at once.
ROW, ASKED, MEMO, MERGE = 100_000, 150_000, 1_000_000, 1_000_000
_U = np.uint64
_END = 0xFF  # in no UTF-8 text
_END_WORD = _U(0x5851F42D4C957F2D)
_FIB = _U(0x9E3779B97F4A7C15)
_GAP = re.compile(rb"[\x20\x09-\x0D]")


# ---------------------------------------------------------------- strings of bytes


Piece = tuple[int, bytes, bytes, bool]  # number of its text, the bytes before it, its own, whether it ends the text


def strings(pieces: list[Piece], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """For every byte and end mark its context and itself as one number, and the number of each piece."""
    end = bytes([_END])
    a = np.frombuffer(b"".join(part for _, before, own, last in pieces for part in (before, own, end if last else b"")), np.uint8)
    n = np.array([len(own) + last for _, _, own, last in pieces], np.int64)
    if not len(pieces):
        return np.zeros(0, np.uint64), n
    g = np.zeros(len(a) - depth, np.uint64)
    for j in range(depth + 1):
        g <<= _U(8)
        g |= a[j : len(a) - depth + j]
    keep = np.ones(len(g), bool)
    start = np.cumsum(n + depth)[:-1] - depth  # strings that end in the bytes before the next piece
    for j in range(depth):
        keep[start + j] = False
    return g[keep], n


def pieces(texts: list[bytes], depth: int = DEPTH, size: int = BLOCK):
    """The texts in order, those over ``size`` cut behind white space, so that words stay whole."""
    pad = bytes([_END]) * depth
    for k, text in enumerate(texts):
        at = 0
        while len(text) - at > size:
            cut = next((m.end() for m in _GAP.finditer(text, at + size)), len(text))
            if cut == len(text):
                break
            yield k, (pad + text[max(0, at - depth) : at])[-depth:], text[at:cut], False
            at = cut
        yield k, (pad + text[max(0, at - depth) : at])[-depth:], text[at:] if at else text, True


def distinct(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and their counts, mostly without sorting: slots that one value each claims."""
    keys, counts = [], []
    factor = _FIB
    bits = max(10, min(21, int(len(g)).bit_length()))
    while len(g) > 20_000:
        slot = ((g * factor) >> _U(64 - bits)).astype(np.int64)
        claim = np.zeros(1 << bits, np.uint64)
        claim[slot] = g
        ok = claim[slot] == g
        got = np.bincount(slot[ok], minlength=1 << bits)
        at = np.flatnonzero(got)
        keys.append(claim[at])
        counts.append(got[at])
        g = g[~ok]
        factor = _U(int(factor) * int(_FIB) % 2**64 | 1)
    k, c = np.unique(g, return_counts=True)
    return np.concatenate([*keys, k]), np.concatenate([*counts, c]).astype(np.int64)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def blocks(texts: list[bytes], depth: int = DEPTH, size: int = BLOCK):
    """Lists of pieces of about ``size`` bytes."""
    part, held = [], 0
    for piece in pieces(texts, depth, size):
        if part and held + len(piece[2]) > size:
            yield part
            part, held = [], 0
        part.append(piece)
        held += len(piece[2])
    if part:
        yield part


class Counts:
    """Counts by key, merged now and then, so that memory follows the distinct keys."""

    def __init__(self) -> None:
        self.keys, self.counts, self.waiting, self.limit = [], [], 0, MERGE

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.waiting += len(keys)
        if self.waiting > self.limit:
            self.done()

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) != 1 or self.waiting:
            k, c = merged(self.keys, self.counts)
            self.keys, self.counts, self.waiting, self.limit = [k], [c], 0, max(MERGE, len(k))
        return self.keys[0], self.counts[0]


# ---------------------------------------------------------------- trees


def _lgamma(x: np.ndarray, plus: float) -> np.ndarray:
    """log gamma(x + plus) of counts: by recurrence up to 16, then Stirling's series."""
    z = x + plus
    shift = np.zeros_like(z)
    for k in range(16):
        small = x < 16 - k
        shift[small] -= np.log(z[small])
        z = np.where(small, z + 1, z)
    return shift + (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _lgamma(zeros, 0.5) + _lgamma(ones, 0.5) - _lgamma(zeros + ones, 1.0) - math.log(math.pi)


def choices(keys: np.ndarray, counts: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``j``-th binary choice of the counted, sorted strings: nodes (context and prefix of the byte), sorted, with zeros and ones."""
    byte = keys & _U(255)
    k = keys >> _U(8) << _U(8) | (_U(1 << j) | (byte >> _U(8 - j)))
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    ones = np.add.reduceat(np.where((byte >> _U(7 - j)) & _U(1), counts, 0), first).astype(np.float64)
    return k[first], np.add.reduceat(counts, first) - ones, ones


def summed(k: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    if not len(k):
        return (k, *values)
    order = np.argsort(k, kind="stable")
    k = k[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return (k[first], *(np.add.reduceat(v[order], first) for v in values))


def signed(share: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Two parts of 1 as one float32: the lesser of both, so that it keeps its own precision; negative if that is ``rest``."""
    return np.where(share <= rest, share, -rest).astype(np.float32)


def unsigned(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(share, rest) of what ``signed`` gave; a share or rest of 0 is told by the sign bit."""
    least = np.abs(v).astype(np.float64)
    rest = np.signbit(v)
    return np.where(rest, 1 - least, least), np.where(rest, least, 1 - least)


def weigh(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(``signed`` weight of a node's own estimate, log of its weighted probability); ``below``: its children's sum."""
    own = log_kt(zeros, ones)
    if below is None:
        return signed(np.ones(len(own)), np.zeros(len(own))), own
    both = np.logaddexp(own, below) - math.log(2)
    return signed(np.exp(own - math.log(2) - both), np.exp(below - math.log(2) - both)), both


def estimates(zeros: np.ndarray, ones: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Of each node the ``signed`` estimate of a one, and the weight."""
    n = zeros + ones + 1
    return np.stack([signed((ones + 0.5) / n, (zeros + 0.5) / n), weight], 1)


def climb(level: tuple[np.ndarray, ...], depth: int, top: int):
    """From nodes of ``depth`` (keys, zeros, ones[, below]) up to ``top``: yields (depth, keys, zeros, ones,
    weight) and at last the sums for the level above ``top``."""
    keys, zeros, ones, *below = level
    while True:
        weight, both = weigh(zeros, ones, below[0] if below else None)
        yield depth, keys, zeros, ones, weight
        up = summed(keys & _U((1 << 8 * depth) - 1), zeros, ones, both)
        if depth == top:
            yield up
            return
        keys, zeros, ones, *below = up
        depth -= 1


class Nodes:
    """Nodes by depth and choice: sorted keys, and of each the ``signed`` estimate of a one and the weight."""

    def __init__(self) -> None:
        self.levels: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def grow(self, level: tuple[np.ndarray, ...], j: int, depth: int, top: int) -> tuple[np.ndarray, ...]:
        """Takes in the nodes of choice ``j`` from ``depth`` up to ``top``; returns the sums for the level above."""
        for got in climb(level, depth, top):
            if len(got) == 5:
                d, k, z, o, w = got
                self.levels[d, j] = k, estimates(z, o, w)
        return got

    def node(self, key: np.ndarray, depth: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        if (depth, j) not in self.levels:
            return np.zeros(len(key), bool), np.zeros((len(key), 2), np.float32)
        keys, values = self.levels[depth, j]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return keys[at] == key, values[at]


class Trees:
    """All nodes of depth ``TOP`` and more of one bucket, above them the upper ones."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, upper: Nodes):
        self.depth, self.upper, self.own = depth, upper, Nodes()
        for j in range(8) if len(keys) else ():
            self.own.grow(choices(keys, counts, j), j, depth, min(TOP, depth))

    def log10(self, g: np.ndarray) -> np.ndarray:
        """Log10 of the probability of the last byte of each string after the others."""
        out = np.zeros(len(g))
        context, byte = g >> _U(8) << _U(8), g & _U(255)
        for j in range(8):
            key = context | (_U(1 << j) | (byte >> _U(8 - j)))
            bit = ((byte >> _U(7 - j)) & _U(1)).astype(bool)
            p, known = np.full(len(g), 0.5), np.zeros(len(g), bool)
            for d in range(self.depth, -1, -1):
                nodes = self.own if d >= min(TOP, self.depth) else self.upper
                found, v = nodes.node(key & _U((1 << 8 * d + 8) - 1), d, j)
                one, zero = unsigned(v[:, 0])
                kt = np.where(bit, one, zero)
                own, below = unsigned(v[:, 1])
                mix = np.where(known, own * kt + below * p, kt)
                p = np.where(found, mix, p)
                known |= found
            out += np.log10(p)
        return out


# ---------------------------------------------------------------- on the cluster


def packed(x: np.ndarray) -> bytes:
    """An array as its compressed bytes, all first bytes of its values first."""
    return pa.compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(b: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = pa.decompress(b, n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).ravel()


def block_words(part: list[Piece]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of pieces, one after the other, and the number of words of each."""
    joined = b" ".join([*(own for _, _, own, _ in part), b""])
    gap = np.concatenate(([True], SPACE[np.frombuffer(joined, np.uint8)]))
    starts = np.flatnonzero(gap[:-1] & ~gap[1:])
    ends = np.cumsum([len(own) + 1 for _, _, own, _ in part])
    return word_hashes(joined), np.diff(np.searchsorted(starts, ends), prepend=0)


class Found:
    """Values by key, for keys of which each is known to be here: one small table of slots, and a search for keys whose slot is another's."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.bits = max(1, len(keys)).bit_length() + 1
        self.slots = np.zeros(1 << self.bits, np.int32)
        self.slots[self._slot(self.keys)] = np.arange(len(keys), dtype=np.int32)

    def _slot(self, g: np.ndarray) -> np.ndarray:
        return ((g * _FIB) >> _U(64 - self.bits)).astype(np.int64)

    def __getitem__(self, g: np.ndarray) -> np.ndarray:
        at = self.slots[self._slot(g)]
        miss = np.flatnonzero(self.keys[at] != g)
        at[miss] = np.searchsorted(self.keys, g[miss])
        return self.values[at]


STRINGS, WORDS, TEXTS = 0, 1, 2


def _chunks(docs: DataFrame, buckets: int, depth: int) -> DataFrame:
    """From (doc_id, text, held): each chunk's distinct strings and words by bucket with their training counts, and its texts."""
    of = docs.schema["doc_id"].dataType
    arrow = to_arrow_type(of)

    def run(batches):
        from pyspark import TaskContext

        chunk, ids, held, texts, size = TaskContext.get().partitionId() << 24, [], [], [], 0
        for batch in batches:
            for i, t, h in zip(*(batch.column(c).to_pylist() for c in range(3))):
                b = (t or "").encode().lower()
                if ids and (size + len(b) > CHUNK or len(ids) >= 100_000):
                    yield made(chunk, ids, held, texts)
                    chunk, ids, held, texts, size = chunk + 1, [], [], [], 0
                ids.append(i)
                held.append(h)
                texts.append(b)
                size += len(b)
        if ids:
            yield made(chunk, ids, held, texts)

    def made(chunk, ids, held, texts):
        gathered = {STRINGS: Counts(), WORDS: Counts()}
        for part in blocks(texts, depth, BLOCK):
            train = ~np.array([held[k] for k, *_ in part], bool)
            g, n = strings(part, depth)
            w, m = block_words(part)
            for kind, values, each in ((STRINGS, g, n), (WORDS, w, m)):
                learned = np.repeat(train, each)
                for some, factor in ((values[learned], 1), (values[~learned], 0)):
                    k, c = distinct(some)
                    gathered[kind].add(k, c * factor)
            ends = sum(bool(t) for t, (*_, last) in zip(train, part) if last)
            gathered[WORDS].add(np.array([_END_WORD]), np.array([ends]))
        rows = []
        for kind, counts in gathered.items():
            k, c = counts.done()
            if kind == STRINGS:
                bucket = (mixed((k >> _U(8)) & _U(256**TOP - 1)) % _U(buckets)).astype(np.int64)
            else:
                bucket = buckets + (((k >> _U(32)) * _U(buckets)) >> _U(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            k, c, bucket = k[order], c[order], bucket[order]
            cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            for a, b in zip(cut, np.append(cut[1:], len(k))):
                rows.append((int(bucket[a]), kind, int(b - a), packed(k[a:b]), packed(c[a:b])))
        joined = b"".join(texts)
        rows.append((None, TEXTS, len(joined), pa.compress(joined, codec="zstd", asbytes=True), None))
        bucket, kind, n, keys, counts = zip(*rows)
        last = [None] * (len(rows) - 1)
        return pa.RecordBatch.from_pydict(
            {
                "bucket": pa.array(bucket, pa.int32()),
                "kind": pa.array(kind, pa.int32()),
                "chunk": pa.array([chunk] * len(rows), pa.int64()),
                "n": pa.array(n, pa.int64()),
                "keys": pa.array(keys, pa.binary()),
                "counts": pa.array(counts, pa.binary()),
                "ids": pa.array([*last, ids], pa.list_(arrow)),
                "held": pa.array([*last, held], pa.list_(pa.bool_())),
                "sizes": pa.array([*last, [len(t) for t in texts]], pa.list_(pa.int64())),
            }
        )

    return docs.mapInArrow(run, f"bucket int, kind int, chunk long, n long, keys binary, counts binary, ids array<{of.simpleString()}>, held array<boolean>, sizes array<long>")


def _by_bucket(rows: DataFrame, buckets: int, *then: str) -> DataFrame:
    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", *then)


def _totals(chunks: DataFrame, buckets: int, depth: int) -> DataFrame:
    """Training counts of each bucket over all chunks; of its words the sums, of its trees what depth 1 needs (a row per node)."""

    def run(batches):
        at, kind, held = None, None, Counts()
        for batch in batches:
            for b, t, n, k, c in zip(*(col.to_pylist() for col in batch.columns)):
                if b != at:
                    yield from summed_up(at, kind, held)
                    at, kind, held = b, t, Counts()
                c = unpacked(c, n, np.int64)
                held.add(unpacked(k, n, np.uint64)[c > 0], c[c > 0])
        yield from summed_up(at, kind, held)

    names = ("bucket", "kind", "choice", "n", "keys", "counts", "ones", "below", "total")
    kinds = dict(zip(names, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64())))

    def row(**values):
        return pa.RecordBatch.from_pydict({name: pa.array([values.get(name)], kind) for name, kind in kinds.items()})

    def summed_up(bucket, kind, held):
        k, c = held.done()
        for a in range(0, len(k), ROW):
            part = slice(a, a + ROW)
            yield row(bucket=bucket, kind=kind, n=len(k[part]), keys=packed(k[part]), counts=packed(c[part]), total=int(c[part].sum()))
        if kind == STRINGS and len(k):
            for j in range(8):
                key, zeros, ones, below = Nodes().grow(choices(k, c, j), j, depth, min(TOP, depth))
                yield row(choice=j, n=len(key), keys=packed(key), counts=packed(zeros), ones=packed(ones), below=packed(below))

    asked = chunks.where(F.col("kind") != TEXTS).select("bucket", "kind", "n", "keys", "counts")
    return _by_bucket(asked, buckets).mapInArrow(run, "bucket int, kind int, choice int, n long, keys binary, counts binary, ones binary, below binary, total long")


def _upper(totals: DataFrame, depth: int) -> Nodes:
    """The nodes above depth ``TOP``. Each choice is summed by a task of its own and comes to the driver as arrays:
    at most 32 bytes for each context of ``TOP - 1`` bytes and prefix, whatever the corpus."""
    top = min(TOP, depth)

    def run(batches):
        sums: dict[int, tuple] = {}
        for batch in batches:
            for j, n, *raw in zip(*(col.to_pylist() for col in batch.columns)):
                level = (unpacked(raw[0], n, np.uint64), *(unpacked(x, n, np.float64) for x in raw[1:]))
                sums[j] = summed(*(np.concatenate(x) for x in zip(sums[j], level))) if j in sums else level
        for j, level in sums.items():
            yield pa.RecordBatch.from_pydict({"choice": pa.array([j], pa.int32()), "n": pa.array([len(level[0])], pa.int64()), **{f"x{i}": pa.array([packed(x)], pa.binary()) for i, x in enumerate(level)}})

    upper = Nodes()
    rows = totals.where("choice is not null").select("choice", "n", "keys", "counts", "ones", "below").repartition(8, "choice")
    for j, n, *raw in rows.mapInArrow(run, "choice int, n long, x0 binary, x1 binary, x2 binary, x3 binary").collect():
        if top:
            level = (unpacked(bytes(raw[0]), n, np.uint64), *(unpacked(bytes(x), n, np.float64) for x in raw[1:]))
            upper.grow(level, j, top - 1, 0)
    return upper


def _answers(chunks: DataFrame, totals: DataFrame, upper: Nodes, buckets: int, depth: int) -> DataFrame:
    """For each chunk and bucket the values of its keys: log probabilities of strings, training counts of words."""
    sent = chunks.sparkSession.sparkContext.broadcast(upper)

    def run(batches):
        at, kind, keys, counts, asked, size, bucket = None, None, [], [], [], 0, None
        for batch in batches:
            for b, t, chunk, n, k, c in zip(*(col.to_pylist() for col in batch.columns)):
                if b != at or size > ASKED:
                    if asked:
                        bucket = bucket or Bucket(kind, keys, counts)
                        yield bucket.answer(asked)
                        asked, size = [], 0
                if b != at:
                    at, kind, keys, counts, bucket = b, t, [], [], None
                if chunk is None:
                    keys.append(unpacked(k, n, np.uint64))
                    counts.append(unpacked(c, n, np.int64))
                else:
                    asked.append((chunk, n, k))
                    size += n
        if asked:
            yield (bucket or Bucket(kind, keys, counts)).answer(asked)

    class Bucket:
        def __init__(self, kind, keys, counts):
            self.kind = kind
            k, c = merged(keys, counts)
            if kind == WORDS:
                self.keys, self.values = k, c
            else:
                self.trees = Trees(k, c, depth, sent.value)
                self.keys, self.values = k[:0], np.zeros(0, np.float32)

        def answer(self, asked):
            g = [unpacked(k, n, np.uint64) for _, n, k in asked]
            one, inverse = np.unique(np.concatenate(g), return_inverse=True)
            at = np.minimum(np.searchsorted(self.keys, one), max(0, len(self.keys) - 1))
            known = self.keys[at] == one if len(self.keys) else np.zeros(len(one), bool)
            got = np.zeros(len(one), self.values.dtype)
            got[known] = self.values[at[known]]
            if self.kind == STRINGS and not known.all():
                new = one[~known]
                got[~known] = self.trees.log10(new)
                keep = len(self.keys) <= MEMO
                k = np.concatenate([self.keys, new]) if keep else new
                v = np.concatenate([self.values, got[~known]]) if keep else got[~known]
                order = np.argsort(k, kind="stable")
                self.keys, self.values = k[order], v[order]
            parts = np.split(got[inverse], np.cumsum([len(x) for x in g])[:-1])
            return pa.RecordBatch.from_pydict(
                {
                    "kind": pa.array([self.kind] * len(asked), pa.int32()),
                    "chunk": pa.array([chunk for chunk, _, _ in asked], pa.int64()),
                    "n": pa.array([n for _, n, _ in asked], pa.int64()),
                    "keys": pa.array([k for _, _, k in asked], pa.binary()),
                    "counts": pa.array([packed(x) for x in parts], pa.binary()),
                }
            )

    columns = ["bucket", "kind", "chunk", "n", "keys", "counts"]
    held = totals.where("kind is not null").withColumn("chunk", F.lit(None).cast("long")).select(columns)
    questions = chunks.where(F.col("kind") != TEXTS).withColumn("counts", F.lit(None).cast("binary")).select(columns)
    # nulls first: a bucket's counts come before what is asked of it
    rows = _by_bucket(held.unionByName(questions), buckets, "chunk")
    return rows.mapInArrow(run, "kind int, chunk long, n long, keys binary, counts binary")


def _by_document(chunks: DataFrame, answers: DataFrame, depth: int) -> DataFrame:
    """Sums each chunk's answers over its texts; a task reads its chunks one after the other, texts first."""
    of = chunks.schema["ids"].dataType.elementType
    arrow = to_arrow_type(of)
    columns = ["chunk", "kind", "n", "keys", "counts", "ids", "held", "sizes"]

    def run(batches):
        at, meta, gathered = None, None, None
        for batch in batches:
            for row in zip(*(col.to_pylist() for col in batch.columns)):
                chunk, kind, n, keys, counts, *texts = row
                if chunk != at:
                    if meta:
                        yield scored(*meta, gathered)
                    at, meta, gathered = chunk, None, {STRINGS: ([], []), WORDS: ([], [])}
                if kind == TEXTS:
                    meta = n, keys, *texts
                else:
                    gathered[kind][0].append(unpacked(keys, n, np.uint64))
                    gathered[kind][1].append(unpacked(counts, n, np.float32 if kind == STRINGS else np.int64))
        if meta:
            yield scored(*meta, gathered)

    def scored(size, raw, ids, held, sizes, gathered):
        joined = pa.decompress(raw, size, codec="zstd", asbytes=True)
        of_string, of_word = (Found(*map(np.concatenate, gathered.pop(kind))) for kind in (STRINGS, WORDS))
        end = int(of_word[np.array([_END_WORD])][0])
        m = len(ids)
        scores, sums, tokens, known = np.zeros(m), np.zeros(m), np.ones(m, np.int64), np.full(m, int(end > 0), np.int64)
        sums += math.log10(end + 1)
        for part in blocks([joined[b - s : b] for b, s in zip(np.cumsum(sizes).tolist(), sizes)], depth, BLOCK):
            text = np.array([k for k, *_ in part])
            g, n = strings(part, depth)
            np.add.at(scores, text, np.add.reduceat(of_string[g].astype(np.float64), np.cumsum(n) - n))
            w, n = block_words(part)
            c, owner = of_word[w], np.repeat(text, n)
            tokens += np.bincount(owner, minlength=m)
            known += np.bincount(owner, c > 0, m).astype(np.int64)
            sums += np.bincount(owner, np.log10(c + 1.0), m)
        return pa.RecordBatch.from_pydict(
            {"doc_id": pa.array(ids, arrow), "held_out": pa.array(held, pa.bool_()), "n_bytes": pa.array(sizes, pa.int64()), "n_tokens": tokens, "n_known": known, "sums": sums, "score": scores}
        )

    texts = chunks.where(F.col("kind") == TEXTS).select(columns)
    rows = texts.unionByName(answers, allowMissingColumns=True).select(columns)
    rows = rows.repartition(max(partitions(chunks.sparkSession), texts.select("chunk").count() // 4), "chunk").sortWithinPartitions("chunk", F.desc("kind"))
    return rows.mapInArrow(run, f"doc_id {of.simpleString()}, held_out boolean, n_bytes long, n_tokens long, n_known long, sums double, score double")


def score_corpus(docs: DataFrame, folds: int = 7, out_fold: int = 2, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every text."""
    held = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds) == out_fold
    rows = docs.select("doc_id", "text", held.alias("held"))
    buckets = max(64, partitions(docs.sparkSession))
    chunks = written(_chunks(rows, buckets, depth), "chunks")
    totals = written(_totals(chunks, buckets, depth), "totals")
    words = totals.where(F.col("kind") == WORDS)
    size = words.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "n"))).first()
    each = math.log10(size["total"] + size["n"] + 1)
    answers = _answers(chunks, totals, _upper(totals, depth), buckets, depth)
    return _by_document(chunks, answers, depth).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(size["total"]).cast("long").alias("train_tokens"), (F.col("sums") - F.col("n_tokens") * F.lit(each)).alias("base_score"), "score",
        (-F.col("score") * F.lit(math.log2(10)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
