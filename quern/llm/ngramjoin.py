"""N-gram Jaccard join by prefix trees.

1. A scan gives every text its number of distinct shingles, a fingerprint of the set (equal
   sets are one class) and counts of all shingles in a sketch of fixed size. The sketch
   orders shingles globally, rare ones first; it decides speed, never the result. As its
   counters fill up with the corpus, shingles met several times in a sample of the texts
   come behind all others.
2. Two sets alike by 80 percent share a shingle among the first fifth of either in that
   order. A second scan deals these prefixes out by shingle. Short posting lists give
   pairs, kept if they share as many prefix shingles as their sizes ask for; long ones
   give stars. Posting lists that the sketch shows to be huge are salted.
3. Stars and pairs make loose groups, of which each true link is inside one. A third scan
   fetches the sets of their members only, past a bitmap of fixed size.
4. Groups are cut into chunks, large ones by bands of set size, and joined in prefix trees
   (``trie.py``): first each chunk with itself, which already connects most near copies; then
   pairs of chunks whose sizes can be alike, but not those of one component, as links within
   it are known to change nothing.

Edge cases: a null or empty text, or one without words, has no shingle, links with nothing
and is its own component; with under five words the whole sequence is the one shingle;
equal texts and repeated rows are linked, also under one id; rows of one id share its
links; a null id has no link and a null component; a text of any length is one set, never a
part of it; an empty table gives an empty result; other columns are ignored, whatever their
names. Shingles are compared by 56 bits of hash and a class.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import trie
from .common import LIKENESS, mixed, partitions, shingle_hashes, word_hashes, written
from .components import components

#: Counters of the sketch, and how many of them are a row when they are summed.
COUNTERS, SLICE = 1 << 20, 1 << 14
#: One text in so many is looked through for common shingles: those that so many distinct texts of the sample have.
SAMPLED, AGAIN = 8, 2
#: Bits of the number of a cell in the table of common shingles, and of those that its parts have in common.
CELL, PART = 24, 10
#: Posting lists up to this length give pairs, longer ones stars.
SHORT = 32
#: Shingles that the sketch counts more often are dealt to several tasks, about so many rows each.
HOT = 1 << 16
#: Bits of the bitmap that lets the members of loose groups pass.
BITS = 1 << 23
#: Sets, and shingles of all its sets, that a chunk holds, about.
CHUNK_SETS, CHUNK_SHINGLES = 384, 2_000_000
#: Rows of a table of large groups or their bands that may be broadcast.
SENT = 100_000
_TOP = np.uint64(56)
_LOW = np.uint64((1 << 56) - 1)
#: Classes from here on are those of common shingles.
_COMMON = 128


def prefix(n: int, likeness: int = LIKENESS) -> int:
    """Shingles of a set of ``n`` of which any set alike must hold one."""
    return n - -(-likeness * n // 100) + 1


def _hashes(text: str | None) -> np.ndarray:
    return shingle_hashes(word_hashes(text.encode())) if text else np.zeros(0, np.uint64)


def _finger(h: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over the set: equal for equal sets."""
    with np.errstate(over="ignore"):
        return int(mixed(h + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)), int(mixed(h ^ _LOW).sum(dtype=np.uint64).view(np.int64))


def _profile(docs: DataFrame) -> DataFrame:
    """Rows of documents (kind 0) and, from each task, of its sketch (kind 1)."""

    def run(batches):
        counts = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            n, one, two, waiting, held = [], [], [], [], 0
            for text in batch.column(1).to_pylist():
                h = _hashes(text)
                a, b = _finger(h)
                n.append(len(h))
                one.append(a)
                two.append(b)
                waiting.append(h)
                held += len(h)
                if held > 1 << 19:
                    add(counts, waiting)
                    waiting, held = [], 0
            if waiting:
                add(counts, waiting)
            k = len(n)
            yield _rows(batch.column(0), [0] * k, n, one, two, [None] * k)
        k = COUNTERS // SLICE
        yield _rows(pa.nulls(k, kind), [1] * k, [0] * k, range(k), [0] * k, [counts[i * SLICE : (i + 1) * SLICE].tobytes() for i in range(k)])

    def add(counts, hashes):
        counts += np.bincount((np.concatenate(hashes) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS).astype(np.uint32)

    def _rows(ids, kinds, n, one, two, sketch):
        cols = [ids.cast(kind), pa.array(kinds, pa.int32()), *(pa.array(x, pa.int64()) for x in (n, one, two)), pa.array(sketch, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "kind", "n", "one", "two", "sketch"])

    from pyspark.sql.pandas.types import to_arrow_type

    of = docs.schema["doc_id"].dataType
    kind = to_arrow_type(of)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {of.simpleString()}, kind int, n long, one long, two long, sketch binary")


def _order(profile: DataFrame) -> np.ndarray:
    """For each counter the class of its shingles, four to an octave: a table of fixed size."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(raw, np.uint32).astype(np.uint64)
        if sums:
            yield pa.RecordBatch.from_pydict({"slice": pa.array(list(sums), pa.int64()), "sums": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    slices = profile.where("kind = 1").select(F.col("one").alias("slice"), "sketch").repartition(COUNTERS // SLICE, "slice")
    out = np.zeros(COUNTERS, np.uint64)
    for k, raw in slices.mapInArrow(add, "slice long, sums binary").collect():
        out[k * SLICE : (k + 1) * SLICE] += np.frombuffer(raw, np.uint64)
    return np.minimum(4 * np.log2(out + 1.0), 255).astype(np.uint8)


def _common(docs: DataFrame) -> np.ndarray:
    """For each cell of a table of fixed size the class of the most common shingle that falls there, 0 without any.

    The sketch can't tell these: its counters hold so many rare shingles each that one of
    some hundred texts hardly shows. Equal texts count once.
    """
    sampled, again, part = SAMPLED, AGAIN, CELL - PART

    def deal(batches):
        for batch in batches:
            waiting, held = [], 0
            for text in batch.column(0).to_pylist():
                waiting.append(_hashes(text))
                held += len(waiting[-1])
                if held > 1 << 19:
                    yield dealt(waiting)
                    waiting, held = [], 0
            if held:
                yield dealt(waiting)

    def dealt(hashes):
        h = np.concatenate(hashes)
        h.sort()  # by cell, too
        parts, start = np.unique(h >> np.uint64(64 - PART), return_index=True)
        return pa.RecordBatch.from_pydict({"part": pa.array(parts.astype(np.int64)), "hashes": pa.array([x.tobytes() for x in np.split(h, start[1:])], pa.binary())})

    def count(batches):
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(k, []).append(raw)
        for k, raws in held.items():
            h, n = np.unique(np.frombuffer(b"".join(raws), np.uint64), return_counts=True)
            h, n = h[n >= again], n[n >= again]
            if len(h):
                cells = np.zeros(1 << part, np.uint8)
                level = np.clip(4 * np.log2(n * float(sampled)), 1, _COMMON - 1).astype(np.uint8)
                np.maximum.at(cells, ((h >> np.uint64(64 - CELL)) & np.uint64((1 << part) - 1)).astype(np.int64), level)
                at = np.flatnonzero(cells)
                yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int64()), "at": pa.array([at.astype(np.uint32).tobytes()], pa.binary()), "level": pa.array([cells[at].tobytes()], pa.binary())})

    texts = docs.select("text", F.xxhash64("text").alias("k")).where((F.col("text") != "") & (F.pmod("k", F.lit(sampled)) == 0)).dropDuplicates(["k"]).select("text")
    parts = texts.mapInArrow(deal, "part long, hashes binary").repartition(partitions(docs.sparkSession), "part")
    out = np.zeros(1 << CELL, np.uint8)
    for k, at, level in parts.mapInArrow(count, "part long, at binary, level binary").toLocalIterator():
        out[(k << part) + np.frombuffer(at, np.uint32).astype(np.int64)] = np.frombuffer(level, np.uint8)
    return out


def _tokens(h: np.ndarray, order: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The set in global order: class and hash of each shingle as one number."""
    levels, common = order
    level = np.minimum(levels[(h & np.uint64(COUNTERS - 1)).astype(np.int64)], _COMMON - 1)
    known = common[(h >> np.uint64(64 - CELL)).astype(np.int64)]
    t = (np.where(known > 0, known + _COMMON, level).astype(np.uint64) << _TOP) | (h >> np.uint64(8))
    t.sort()
    return t


def _prefixes(docs: DataFrame, order: tuple[np.ndarray, np.ndarray], likeness: int) -> DataFrame:
    """(token, salt, set, doc_id, n) of the prefix of every distinct set that a task meets."""
    table = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            ids, parts, held = [], [], 0
            for row, text in enumerate(batch.column(1).to_pylist()):
                h = _hashes(text)
                one = _finger(h)[0]
                if not len(h) or one in seen:
                    continue
                if len(seen) < 1 << 20:  # only saves rows; what passes twice is one set again below
                    seen.add(one)
                t = _tokens(h, table.value)[: prefix(len(h), likeness)]
                level = (t >> _TOP).astype(np.int64) % _COMMON
                shards = np.maximum(1, np.exp2(level / 4).astype(np.int64) // HOT)
                parts.append((t.view(np.int64), np.where(shards > 1, (one & 0x7FFFFFFF) % shards, -1).astype(np.int32), np.full(len(t), one), np.full(len(t), len(h))))
                ids.append(np.full(len(t), row))
                held += len(t)
                if held > 200_000:
                    yield made(batch, ids, parts)
                    ids, parts, held = [], [], 0
            if parts:
                yield made(batch, ids, parts)

    def made(batch, ids, parts):
        token, salt, one, n = (np.concatenate(c) for c in zip(*parts))
        return pa.RecordBatch.from_arrays(
            [pa.array(token), pa.array(salt), pa.array(one), batch.column(0).take(pa.array(np.concatenate(ids))), pa.array(n.astype(np.int32))], ["token", "salt", "set", "doc_id", "n"]
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, f"token long, salt int, set long, doc_id {kind}, n int")
    return rows.repartition(partitions(docs.sparkSession), "token", "salt").sortWithinPartitions("token", "salt", "set", "doc_id")


def _postings(rows: DataFrame, likeness: int) -> DataFrame:
    """Streams sorted postings into rows (kind, token, a, b, na, nb): pairs 0, stars 1, heads of salted parts 2."""
    of = rows.schema["doc_id"].dataType
    schema = StructType([StructField("kind", LongType()), StructField("token", LongType()), StructField("a", of), StructField("b", of), StructField("na", LongType()), StructField("nb", LongType())])

    def run(batches):
        tail = None  # the last list of the rows so far, while it is short
        star = None  # of a long list under way: token, salt, its first row, the set last seen
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if tail is not None:
                t, tail = pa.concat_tables([tail, t]), None
            if star:
                token, salt = t.column(0).to_numpy(), t.column(1).to_numpy()
                same = (token == star[0]) & (salt == star[1])
                k = len(same) if same.all() else int(same.argmin())
                lead = t.slice(0, k)
                lead = lead.filter(pa.array(_first_of(lead.column(2).to_numpy(), star[3])))
                if lead.num_rows:
                    yield from emit(pa.concat_tables([star[2], lead]), long=True)
                    star = (*star[:3], lead.column(2)[-1].as_py())
                t = t.slice(k)
                if not t.num_rows:
                    continue
                star = None
            token, salt, one = (t.column(i).to_numpy() for i in range(3))
            new = np.concatenate(([True], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1]) | (one[1:] != one[:-1])))
            t = t.filter(pa.array(new))
            token, salt = t.column(0).to_numpy(), t.column(1).to_numpy()
            last = int(np.flatnonzero(np.concatenate(([True], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1]))))[-1])
            yield from emit(t.slice(0, last))
            tail = t.slice(last)
            if tail.num_rows > SHORT:
                yield from emit(tail)
                star, tail = (int(token[-1]), int(salt[-1]), tail.slice(0, 1), tail.column(2)[-1].as_py()), None
        if tail is not None:
            yield from emit(tail)

    def _first_of(one, before):
        return np.concatenate(([before], one))[1:] != np.concatenate(([before], one))[:-1]

    def emit(t, long=False):
        if not t.num_rows:
            return
        token, salt, n = t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(4).to_numpy().astype(np.int64)
        ids = t.column(3).combine_chunks()
        start = np.flatnonzero(np.concatenate(([True], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1]))))
        size = np.diff(np.append(start, len(token)))
        salted = salt[start] >= 0
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        short = (size > 1) & (size <= SHORT) & ~salted & (not long)
        for k in np.unique(size[short]):
            i, j = np.triu_indices(k, 1)
            at = start[short & (size == k)][:, None]
            left.append((at + i).ravel())
            right.append((at + j).ravel())
        a, b = np.concatenate(left), np.concatenate(right)
        near = 100 * np.minimum(n[a], n[b]) >= likeness * np.maximum(n[a], n[b])
        a, b = a[near], b[near]
        kind = np.zeros(len(a), np.int64)
        starry = (size > SHORT) | salted | long
        for s, e in zip(start[starry], (start + size)[starry]):
            rest = np.arange(s + 1, e)
            a, b, kind = np.concatenate((a, np.full(len(rest), s))), np.concatenate((b, rest)), np.concatenate((kind, np.ones(len(rest), np.int64)))
        heads = start[salted]
        a, b, kind = np.concatenate((a, heads)), np.concatenate((b, heads)), np.concatenate((kind, np.full(len(heads), 2)))
        if len(a):
            cols = [pa.array(kind), pa.array(token[a]), ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(n[a]), pa.array(n[b])]
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    return rows.mapInArrow(run, schema)


def _loose(postings: DataFrame, likeness: int) -> DataFrame:
    """Edges (a, b) of the loose groups."""
    pairs = postings.where("kind = 0").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("na") + F.col("nb")).alias("s"), F.greatest("na", "nb").alias("m"))
    least = F.ceil(F.lit(likeness) * F.col("s") / (100 + likeness) - 1e-9)
    rest = F.ceil(F.lit(likeness) * F.col("m") / 100 - 1e-9) - 1
    # no more than ``rest`` of a common overlap can lie behind both prefixes
    pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.max("s").alias("s"), F.max("m").alias("m")).where(F.col("c") >= least - rest).select("a", "b")
    stars = postings.where("kind = 1").select("a", "b").distinct()
    heads = postings.where("kind = 2").select("token", "a").distinct()
    heads = heads.join(heads.groupBy("token").agg(F.min("a").alias("b")), "token").select("a", "b")
    return pairs.unionByName(stars).unionByName(heads).distinct()


def _bitmap(ids: DataFrame) -> np.ndarray:
    """A table of fixed size with the bit of every id set."""
    bit = F.pmod(F.xxhash64("node"), F.lit(BITS))
    words = ids.select(bit.alias("bit")).groupBy(F.shiftright("bit", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 32 AS int)))").alias("x")).toPandas()
    out = np.zeros(BITS // 32, np.uint32)
    out[words["w"].to_numpy()] = words["x"].to_numpy().astype(np.uint32)
    return np.unpackbits(out.view(np.uint8), bitorder="little")


def _sets(docs: DataFrame, members: DataFrame, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(node, n, tokens) of the members; distinct sets of an id are rows of their own."""
    spark = docs.sparkSession
    table, bits = spark.sparkContext.broadcast(order), spark.sparkContext.broadcast(np.packbits(_bitmap(members)))

    def run(batches):
        for batch in batches:
            at = np.flatnonzero(np.unpackbits(bits.value)[batch.column(2).to_numpy()])
            if not len(at):
                continue
            texts = batch.column(1).take(pa.array(at)).to_pylist()
            for a in range(0, len(at), 256):
                sets = [_tokens(_hashes(x), table.value) for x in texts[a : a + 256]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at[a : a + 256])), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["node", "n", "tokens"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.where("doc_id is not null").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(BITS)).alias("bit"))
    return rows.mapInArrow(run, f"node {kind}, n long, tokens binary").where("n > 0").join(members, "node")


def _sent(rows: DataFrame) -> DataFrame:
    """``rows``, written, to be broadcast if there are at most ``SENT`` of them, and joined by key otherwise."""
    rows = written(rows, "groups")
    return F.broadcast(rows) if rows.count() <= SENT else rows


def _joined(blocks: DataFrame, likeness: int) -> DataFrame:
    """Links (a, b) that connect what blocks (g, x, y; node, comp, tokens) hold: a forest of each block."""

    def run(table: pa.Table) -> pa.Table:
        nodes, comps = table.column("node").combine_chunks(), table.column("comp").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]
        parent: dict = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        left, right = [], []
        if len(set(comps)) > 1:
            for probes, s in trie.links(sets, likeness):
                b = root(comps[s])
                for p in probes:
                    if (a := root(comps[p])) != b:
                        parent[a] = b
                        left.append(int(p))
                        right.append(s)
        return pa.table({"a": nodes.take(pa.array(left, pa.int64())), "b": nodes.take(pa.array(right, pa.int64()))})

    kind = blocks.schema["node"].dataType.simpleString()
    # dealt by block: a join by group would leave all blocks of a group in one task
    blocks = blocks.select("g", "x", "y", "node", "comp", "tokens").repartition(partitions(blocks.sparkSession), "g", "x", "y")
    return blocks.groupBy("g", "x", "y").applyInArrow(run, f"a {kind}, b {kind}")


def jaccard_links(docs: DataFrame, profile: DataFrame, likeness: int = LIKENESS) -> DataFrame:
    """(node, component) of the documents that have a link to a different set."""
    order = _order(profile), _common(docs)
    postings = written(_postings(_prefixes(docs, order, likeness), likeness), "postings")
    groups = components(_loose(postings, likeness)).withColumnRenamed("component", "g")
    sets = written(_sets(docs, groups, order), "sets")

    # chunks of a group, by bands of size if there are several, and each with itself
    need = lambda m, w: F.ceil(F.greatest(m / CHUNK_SETS, w / CHUNK_SHINGLES)).cast("int")
    sized = need(F.count(F.lit(1)), F.sum("n"))
    sets = sets.withColumn("band", F.floor(F.log("n") / math.log(100 / min(likeness, 99))).cast("int"))
    large = _sent(sets.groupBy("g").agg(sized.alias("k")).where("k > 1").select("g"))
    bands = _sent(sets.join(large, "g").groupBy("g", "band").agg(sized.alias("own")))
    place = F.when(F.col("own").isNotNull(), F.concat_ws(":", "band", F.pmod(F.hash("node"), F.col("own"))))
    rows = sets.join(bands, ["g", "band"], "left").withColumn("x", F.coalesce(place, F.lit("")))
    first = written(_joined(rows.withColumn("y", F.col("x")).withColumn("comp", F.col("node")), likeness), "links")
    cut = written(rows.where("own is not null").select("g", "node", "n", "band"), "cut")
    if cut.isEmpty():
        return components(first)

    # what is left of the groups of several chunks: large components and bands of size in chunks of their own, then pairs of chunks
    found = components(first)
    cut = cut.join(found, "node", "left").select("g", "node", "n", "band", F.coalesce("component", "node").alias("comp"))
    size = cut.groupBy("g", "comp").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w"))
    size = size.select("g", "comp", need(F.col("m"), F.col("w")).alias("own"), ((F.col("m") >= CHUNK_SETS // 2) | (F.col("w") >= CHUNK_SHINGLES // 2)).alias("alone"))
    cut = cut.join(size, ["g", "comp"])
    mixed = cut.where("not alone").groupBy("g", "band").agg(sized.alias("mixed"))
    cut = cut.join(mixed, ["g", "band"], "left")
    chunk = F.when(F.col("alone"), F.concat_ws(":", F.lit("c"), F.col("comp").cast("string"), F.pmod(F.hash("node"), F.col("own"))))
    chunk = chunk.otherwise(F.concat_ws(":", F.lit("m"), "band", F.pmod(F.hash("comp"), F.col("mixed"))))
    cut = written(cut.select("g", "node", "n", "comp", "alone", chunk.alias("chunk")), "cut")
    chunks = cut.groupBy("g", "chunk").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min(F.when(F.col("alone"), F.col("comp"))).alias("pure"))
    other = chunks.toDF("g2", "chunk2", "low2", "high2", "pure2")
    apart = F.col("pure").isNull() | F.col("pure2").isNull() | (F.col("pure") != F.col("pure2"))
    # sets alike are of like sizes
    apart = apart & (100 * F.col("high") >= likeness * F.col("low2")) & (100 * F.col("high2") >= likeness * F.col("low"))
    pairs = chunks.join(other, (F.col("g") == F.col("g2")) & (F.col("chunk") <= F.col("chunk2")) & apart).select("g", F.col("chunk").alias("x"), F.col("chunk2").alias("y"))
    places = pairs.select("g", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("chunk"))
    blocks = sets.select("g", "node", "tokens").join(cut.select("node", "comp", "chunk"), "node").join(places, ["g", "chunk"])
    second = written(_joined(blocks, likeness), "links")
    stars = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return components(stars.unionByName(second))


def ngram_join(docs: DataFrame, likeness: int = LIKENESS) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id, the least id reachable by links."""
    profile = written(_profile(docs), "profile")
    every = profile.where("kind = 0").select("doc_id", F.col("n").alias("n_shingles"), "one", "two")
    some = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    rows, same = every.where(some), ["n_shingles", "one", "two"]
    classes = rows.groupBy(*same).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("m"))
    linked = jaccard_links(docs, profile, likeness)
    # a node stands for its class: the components of classes, by the least id of each
    class_of = every.where("n_shingles > 0").select(F.col("doc_id").alias("node"), *same).join(linked, "node")
    via = class_of.join(classes, same).groupBy("component").agg(F.min("least").alias("lowest"))
    of_class = class_of.join(via, "component").groupBy(*same).agg(F.min("lowest").alias("lowest"))
    classes = classes.join(of_class, same, "left").select(*same, "m", F.coalesce("lowest", "least").alias("component"))
    classes = written(classes, "classes")
    # classes of many copies, of which there are at most 1,000, go to the rows; the others are joined by class
    most = max(1_000, rows.count() // 1_000)
    hot = F.broadcast(classes.where(F.col("m") > most).drop("m"))
    cold = rows.join(hot, same, "left_anti").join(classes.where(F.col("m") <= most), same)
    alone = every.where(~some).withColumn("component", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", F.col("component").alias("component_id")]
    return rows.join(hot, same).select(*columns).unionByName(cold.select(*columns)).unionByName(alone.select(*columns))
