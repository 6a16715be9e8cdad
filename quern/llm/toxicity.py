"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (and itself), hashed into ``BUCKETS`` rows of an
embedding; its vector is their mean, that of a window the mean over its words, and a
linear softmax over it gives the probability of the label. Embedding and softmax are
trained together. A text is as toxic as its most toxic window, so a few words in a very
long text count as much as in a short one. Words that training has not seen, misspellings
among them, share n-gram vectors with those it has.

With two labels, what scoring needs of the model is one number per n-gram bucket (its
embedding times the difference of the softmax rows): a table of fixed size, whatever the corpus.

Edge cases: a null or empty text, or one without words, scores as an empty window does
(the bias alone); a text of any length is scored whole, window by window; equal texts, and
so repeated rows, score alike; rows whose label is null are not learned from, and of rows of
one id the one whose words sort first; without labels of both kinds every score is that of the
bias; ties of the sample's hashes go by id; an empty table gives an empty result. Other columns,
whatever their names, pass through, but for ``score`` and ``predicted``, which are replaced.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named

#: Size of the embedding, and lengths of n-grams.
BUCKETS, DIM, NGRAMS = 1 << 17, 4, (3, 4, 5)  # BUCKETS: the top 17 bits of 32-bit hashes
#: Words in a window, and the distance of windows.
WINDOW, STRIDE = 4, 2
#: Labelled rows that are learned from: at most so many of either label, those of least id hash.
SAMPLE = {1: 1300, 0: 2600}
#: Words kept with their score on a task.
CACHE = 400_000
#: Scores from which a text is toxic.
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """The distinct words, lower-cased, in order of their first places: repetition adds nothing."""
    return list(dict.fromkeys(_WORD.findall(text.lower()))) if text else []


def buckets_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the embedding that each word averages, one word after the other, and their numbers."""
    raw = [f"<{w}>".encode() for w in words]
    size = np.array([len(x) for x in raw], np.int64)
    a = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(a))  # bytes from here to the word's end
    word = np.repeat(np.arange(len(raw), dtype=np.int64), size)
    rows, owner = [np.array([zlib.crc32(x) for x in raw], np.uint32) >> 15], [np.arange(len(raw))]
    for n in NGRAMS:
        if len(a) < n:
            break
        h = np.full(len(a) - n + 1, n, np.uint32)
        for j in range(n):
            h = (h ^ a[j : len(a) - n + 1 + j]) * np.uint32(0x01000193)
        inside = left[: len(h)] >= n
        rows.append((h[inside] * np.uint32(0x9E3779B1)) >> 15)
        owner.append(word[: len(h)][inside])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(rows)[order].astype(np.int32), np.bincount(owner, minlength=len(raw))


@dataclass
class Model:
    #: For each bucket, how far its n-gram speaks for the label.
    weights: np.ndarray
    bias: float

    def words(self, words: list[str]) -> np.ndarray:
        """How far each word speaks for the label: the mean over its n-grams."""
        if not words:
            return np.zeros(0)
        rows, size = buckets_of(words)
        return np.add.reduceat(self.weights[rows].astype(np.float64), np.cumsum(size) - size) / size

    def logit(self, words: np.ndarray) -> float:
        """Of scored words: the bias and the largest mean of a window."""
        return self.bias + (float(window_means(words).max()) if len(words) else 0.0)


def window_means(words: np.ndarray) -> np.ndarray:
    """Means of the windows of a text; the last ends at its end."""
    n = len(words)
    if n <= WINDOW:
        return words.mean(keepdims=True)
    total = np.concatenate(([0.0], np.cumsum(words, dtype=np.float64)))
    start = _starts(n)
    return (total[start + WINDOW] - total[start]) / WINDOW


def _starts(n: int) -> np.ndarray:
    last = max(0, n - WINDOW)
    start = np.arange(0, last + 1, STRIDE)
    return start if start[-1] == last else np.append(start, last)


def train(texts: list[str | None], labels: list[int], epochs: int = 100, warm: int = 15, rate: float = 0.3, decay: float = 0.003, seed: int = 7) -> Model:
    """Gradient descent with momentum over the whole sample. The first epochs learn from
    whole texts, the others from each text's most toxic window, of both labels, with one window of clean texts at random beside it.

    All rows of the embedding share one step size, set by the steepest, so n-grams of words that many toxic texts hold
    move furthest, and those of a text's own words hardly; softmax and bias take Adam's steps."""
    y = np.asarray(labels, np.float32)
    ids: dict[str, int] = {}
    docs = [np.array([ids.setdefault(w, len(ids)) for w in words_of(t)], np.int32) for t in texts]
    docs, y = zip(*[(d, l) for d, l in zip(docs, y) if len(d)]) if any(map(len, docs)) else ((), ())
    y = np.array(y, np.float32)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(BUCKETS, np.float32), math.log((share + 0.01) / (1.01 - share)))
    rng = np.random.default_rng(seed)
    words = list(ids)
    parts = [buckets_of(words[k : k + 20_000]) for k in range(0, len(words), 20_000)]  # in parts, for the driver's memory
    flat, size = (np.concatenate(x) for x in zip(*parts))
    del words, parts
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
    del ids
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    soft = rng.normal(0, 0.5, (2, DIM)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (emb, soft, bias)]
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)

    for epoch in range(epochs):
        vec = np.stack([np.add.reduceat(emb[:, d][flat], start) / size for d in range(DIM)], 1).astype(np.float32)
        if epoch < warm:
            spans = [(d, lab, wt) for d, lab, wt in zip(docs, y, balance)]
        else:
            speaks = vec @ (soft[1] - soft[0])
            spans = []
            for d, lab, wt in zip(docs, y, balance):
                s = _starts(len(d))
                k = int(window_means(speaks[d]).argmax())
                spans.append((d[s[k] : s[k] + WINDOW] if len(d) > WINDOW else d, lab, wt))
                if lab == 0:
                    j = s[rng.integers(len(s))]
                    spans.append((d[j : j + WINDOW], lab, wt))
        n = np.array([len(s[0]) for s in spans])
        tok = np.concatenate([s[0] for s in spans])
        lab = np.array([s[1] for s in spans], np.float32)
        wt = np.array([s[2] for s in spans], np.float32)
        at = np.concatenate(([0], np.cumsum(n)[:-1]))
        bag = np.stack([np.add.reduceat(vec[:, d][tok], at) for d in range(DIM)], 1) / n[:, None]
        z = bag @ soft.T + bias
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        g = p
        g[np.arange(len(lab)), lab.astype(int)] -= 1
        g *= (wt / wt.sum())[:, None]
        g_bag = (g @ soft) / n[:, None]
        span_of = np.repeat(np.arange(len(n)), n)
        g_vec = np.stack([np.bincount(tok, g_bag[:, d][span_of], len(size)) for d in range(DIM)], 1) / size[:, None]
        g_emb = np.stack([np.bincount(flat, g_vec[:, d][owner], BUCKETS) for d in range(DIM)], 1).astype(np.float32)
        for x, grad, (m, v) in zip((emb, soft, bias), (g_emb, g.T @ bag, g.sum(0)), moments):
            m *= 0.9
            m += 0.1 * grad
            step = m / (1 - 0.9 ** (epoch + 1))
            if x is emb:
                x -= rate * step / (np.abs(step).max() + 1e-12)
                x *= 1 - decay
                continue
            v *= 0.999
            v += 0.001 * grad * grad
            x -= rate * step / (np.sqrt(v / (1 - 0.999 ** (epoch + 1))) + 1e-8)
    return Model((emb @ (soft[1] - soft[0])).astype(np.float32), float(bias[1] - bias[0]))


def training_rows(docs: DataFrame, labels: DataFrame, column: str = "toxic", sample: dict[int, int] | None = None) -> tuple[list, list]:
    """Texts, of their distinct words only, and labels of a bounded sample: per label, the rows whose ids hash lowest."""
    spark = docs.sparkSession
    # ids first: only the words of the sample, whose size is bounded, leave the executors
    found = docs.select("doc_id").join(labels.select("doc_id", F.col(column).cast("int").alias("label")), "doc_id").distinct()
    marks = []
    for label, most in (sample or SAMPLE).items():
        marks += found.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    if not marks:
        return [], []
    chosen = spark.createDataFrame(marks, found.schema)

    def words(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([" ".join(words_of(t)) for t in batch.column(2).to_pylist()], pa.string())], ["doc_id", "label", "words"])

    got = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    got = got.mapInArrow(words, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int, words string")
    rows = got.groupBy("doc_id", "label").agg(F.min("words").alias("words")).collect()
    rows.sort(key=lambda r: (r["label"], r["doc_id"]))
    return [r["words"] for r in rows], [r["label"] for r in rows]


def scorer(model: Model, place: int):
    """A function for mapInArrow over rows whose text is the column at ``place``: the same rows with ``score`` appended."""
    weights, bias = model.weights, model.bias

    def score(batches):
        own = Model(weights, bias)
        known: dict[str, float] = {}
        for batch in batches:
            out = []
            texts = batch.column(place)
            for at in range(0, len(texts), 256):
                docs = [words_of(t) for t in texts.slice(at, 256).to_pylist()]
                if len(known) > CACHE:
                    known.clear()
                new = list({w for d in docs for w in d}.difference(known))
                known.update(zip(new, own.words(new).tolist()))
                for d in docs:
                    z = own.logit(np.fromiter(map(known.__getitem__, d), np.float64, len(d)))
                    out.append(1 / (1 + math.exp(-max(-500.0, min(500.0, z)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "score"])

    return score


def score_toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with ``score`` and ``predicted`` (1 from ``threshold`` on)."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    keep = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    plain = docs.select(*(named(c).alias(f"c{i}") for i, c in enumerate(keep)))  # mapInArrow takes no names that need quoting
    schema = StructType([*plain.schema.fields, StructField("score", DoubleType())])
    rows = plain.mapInArrow(scorer(model, keep.index("text")), schema)
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
