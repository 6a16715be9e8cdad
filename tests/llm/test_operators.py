"""Each operator on a small table of awkward rows, held against brute force."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import common, ctw, linededup, media, mixing, ngramjoin, packing, rollup, toxicity, trie, warc, winnowing
from quern.llm.components import components
from quern.llm.queries import tokenizer

WORDS = re.compile(r"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, n long, token string, range int"


def lower(text):
    return (text or "").encode().lower().decode()


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 6)))
    base = [" ".join(word() for _ in range(r.randrange(5, 120))) for _ in range(60)]
    out = dict(enumerate(base))
    for i in range(60, 140):  # near copies
        w = base[r.randrange(12)].split()
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(len(w))] = word()
        out[i] = " ".join(w)
    for i in range(140, 170):  # a hot group of copies, in other letters
        out[i] = base[0].replace("a", "A")
    line = lambda: " ".join(word() for _ in range(4))
    common_lines = [line() for _ in range(8)]
    for i in range(170, 190):
        out[i] = "\n".join([line(), "", *common_lines[r.randrange(3) : r.randrange(4, 8)], line()])
    out |= {190: None, 191: "", 192: " \t\n ", 193: "one", 194: "one two three four", 195: "one two three four", 196: "x\n" * 9, 197: " ".join(word() for _ in range(9000)), 198: "A b\nA b\nA b\nA b\nA b", 199: "<|endoftext|> x"}
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None][i % 3], None if i % 11 == 0 else f"s{i % 4}", len(t or ""), 1, 0.5, 1, "t", 1) for i, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def nulls(spark):
    """Null ids, repeated rows, and nulls in every column."""
    return spark.createDataFrame([(None, "a b c d e f", None, None, None, None, None, None, None, None), (1, "a b c d e f", "en", "s", 1, 1, 1.0, 1, "t", 1), (1, "a b c d e f", "en", "s", 1, 1, 1.0, 1, "t", 1), (None, None, None, None, None, None, None, None, None, None)], SCHEMA)


# ---------------------------------------------------------------- words and shingles


@pytest.mark.parametrize("text", ["", " ", "a", "A a", "x\ty\x0bz\r\n w", "é É", "a" * 70000 + " b"])
def test_word_hashes(text):
    h = common.word_hashes(text.encode())
    words = WORDS.findall(lower(text))
    assert len(h) == len(words)
    assert len(set(h.tolist())) == len(set(words))
    assert all((h[i] == h[j]) == (words[i] == words[j]) for i in range(len(h)) for j in range(i))


# ---------------------------------------------------------------- 1 packing


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer())
    got, seqs = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, tokenizer()).collect():
        got[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    total = 0
    for i, text in texts.items():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        at = 0
        for k, r in enumerate(sorted(got[i], key=lambda r: r.piece)):
            part = ids[at : at + r.length]
            assert (r.piece, r.start) == (k, at) and (r.length == 2048 or k == 0)
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += r.length
        assert at == len(ids)
    for places in seqs.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(seqs) <= -(-total // 2048) + 1


def test_packing_edges(empty, nulls):
    assert packing.pack(empty, tokenizer()).collect() == []
    assert packing.pack(nulls, tokenizer()).count() == 4


def test_ids_of_odd_texts():
    """Long runs of white space, special strings, long words: the library's own ids."""
    from tokenizers import Tokenizer

    t, encode = Tokenizer.from_file(tokenizer()), packing.encoder(tokenizer())
    for text in (" " * 2_000_000, "\t" * 2_000_000, "\n " * 1_000_000, "x" + " " * 1_200_000 + "y", "x\u00a0" * 40_000 + "\u3000" * 120_000 + "z", " " * (packing.RUN - 1) + "a", "a" * 300_000, "<|endoftext|>" * 3, "it's 12 \r\n\v\f é"):
        assert encode(text) == t.encode(text, add_special_tokens=False).ids, text[:3]


def test_other_tokenizer_files_are_taken_as_they_are(tmp_path):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    text = "The Quick  brown\tfox's 12 é\n\n<|startoftext|>" + " " * 50
    spec = json.load(open(tokenizer(), encoding="utf-8"))
    assert packing.plain_byte_bpe(spec)
    spec["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "lower.json").write_text(json.dumps(spec), encoding="utf-8")
    spec["normalizer"], spec["pre_tokenizer"]["add_prefix_space"] = None, True
    (tmp_path / "space.json").write_text(json.dumps(spec), encoding="utf-8")
    for path in (str(tmp_path / "lower.json"), str(tmp_path / "space.json"), public_tokenizers.path("word_bpe_49k.json")):
        assert packing.encoder(path)(text) == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, path


@pytest.mark.parametrize("seed", range(3))
def test_plan_uses_every_length_once(seed):
    r = random.Random(seed)
    lengths = [min(2048, int(r.expovariate(1 / 600)) + 1) for _ in range(3000)]
    p = packing.plan(Counter(lengths))
    used = Counter()
    for n, c in p.classes:
        assert sum(c) <= 2048 and n > 0
        for x in c:
            used[x] += n
    assert used == Counter(lengths)
    assert p.sequences <= 1.01 * sum(lengths) / 2048 + 1


def test_nnls():
    rng = np.random.default_rng(0)
    a, want = rng.random((12, 8)), np.maximum(rng.normal(size=8), 0)
    assert np.allclose(packing.nnls(a, a @ want), want, atol=1e-6)


# ---------------------------------------------------------------- 2 WARC


def page_frame(spark):
    big = "x" * 150
    rows = [(1, "http://a/", big), (2, "http://b/", big), (3, None, big), (4, "http://c/", "small"), (5, "u\r\nv", "small"), (6, "http://d/", None), (7, "http://e/", ""), (8, "http://f/", "é" * 300_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark):
    pages = page_frame(spark)
    got = {r.page_id: r for r in warc.warc_round_trip(spark, pages).collect()}
    first = {}
    for p in pages.orderBy("page_id").collect():
        data = (p.html or "").encode()
        r = got.pop(p.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        origin = first.setdefault(data, p.page_id) if len(data) >= 100 else p.page_id
        assert (r.record_type, r.refers_to) == (("response", None) if origin == p.page_id else ("revisit", origin))
    assert not got
    assert warc.warc_round_trip(spark, pages.limit(0)).collect() == []


def test_warc_of_null_and_repeated_pages(spark):
    big, other = "x" * 150, "y" * 150
    rows = [(None, big, 1), (2, big, 1), (2, big, 1), (5, big, 1), (None, other, 1), (None, other, 1), (7, None, 1), (7, None, 1)]
    pages = spark.createDataFrame([(i, None, h, k) for i, h, k in rows], "page_id long, url string, html string, digest long")
    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes) for r in warc.warc_round_trip(spark, pages).collect())
    assert got == [(0, "response", 0, 150), (0, "response", 0, 150), (0, "revisit", 2, 150), (2, "response", 0, 150), (2, "response", 0, 150), (5, "revisit", 2, 150), (7, "response", 0, 0), (7, "response", 0, 0)]


def test_warc_query_pushes_down(spark, small):
    """The query's two scans: responses with payloads, revisits by headers, with both predicates in the source."""
    from quern.llm.queries import op2_warc

    plan = op2_warc(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan warc") == 2
    assert "= response" not in plan and "= revisit" not in plan  # Spark doesn't test them again


def test_warc_pushdown_and_payloads(spark):
    path = common.new_dir(spark, "warc")
    warc.write_warc(page_frame(spark), path).collect()
    df = warc.read_warc(spark, path)
    assert {r.refers_to for r in df.where("record_type = 'revisit'").collect()} == {"<urn:page:1>"}
    assert df.where("record_type = 'response' and target_uri like 'http://f%'").select(F.octet_length("payload")).first()[0] == 600_000
    assert {r.payload for r in warc.read_warc(spark, path, payload=False).collect()} == {None}
    reader = warc.WarcReader({"path": path, "payload": "false"})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("date",), "x")]))
    assert len(left) == 1 and reader._wanted({"WARC-Type": "revisit"}) and not reader._wanted({"WARC-Type": "response"})


def test_warc_plain_and_foreign_members(tmp_path):
    import gzip
    import io

    one = warc.record("response", 1, "http://a/", b"payload", "d", None, "2026-01-01T00:00:00Z")
    two = warc.record("revisit", 2, "http://b/", b"payload", "d", 1, "2026-01-01T00:00:00Z")
    for data in (one + two, gzip.compress(one) + gzip.compress(two), warc.member(one) + warc.member(two)):
        got = list(warc.records(io.BytesIO(data), len(data), lambda h: True))
        assert [(h["X-Page-ID"], p) for h, p in got] == [("1", b"payload"), ("2", None)]
        assert [h["X-Page-ID"] for h, _ in warc.records(io.BytesIO(data), len(data), lambda h: h["WARC-Type"] == "revisit")] == ["2"]
    assert gzip.decompress(warc.member(one) + warc.member(two)) == one + two


# ---------------------------------------------------------------- 3 n-gram join


def brute_components(texts, likeness=80):
    sets = {}
    for i, t in texts.items():
        w = WORDS.findall(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    least = {i: i for i in texts}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= likeness * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                least[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("shape", [{}, {"SHORT": 2, "CHUNK_SETS": 6}, {"HOT": 4, "CHUNK_SETS": 6, "CHUNK_SHINGLES": 300}])
def test_ngram_join(docs, texts, monkeypatch, shape):
    for k, v in shape.items():
        monkeypatch.setattr(ngramjoin, k, v)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.ngram_join(docs).collect()}
    assert got == brute_components(texts)


def test_ngram_join_with_common_shingles(docs, texts, monkeypatch):
    """Every text is in the sample, and what two texts share is common there."""
    monkeypatch.setattr(ngramjoin, "SAMPLED", 1)
    monkeypatch.setattr(ngramjoin, "AGAIN", 2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.ngram_join(docs).collect()}
    assert got == brute_components(texts)


def test_common_passages_make_no_loose_groups(spark, monkeypatch):
    """Under a sketch too full to tell, texts that share a passage and no more are not fetched."""
    monkeypatch.setattr(ngramjoin, "SAMPLED", 1, raising=False)
    monkeypatch.setattr(ngramjoin, "_order", lambda profile: np.zeros(ngramjoin.COUNTERS, np.uint8))
    fetched, sets = [], ngramjoin._sets
    monkeypatch.setattr(ngramjoin, "_sets", lambda docs, members, order: fetched.append(members.count()) or sets(docs, members, order))
    rows = [(i, " ".join([*(f"p{i % 3}w{n}" for n in range(12)), *(f"d{i}w{n}" for n in range(40))])) for i in range(300)]
    rows.append((300, rows[7][1].replace("d7w39", "x")))
    got = {r.doc_id: r.component_id for r in ngramjoin.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 7 if i == 300 else i for i, _ in rows}
    assert fetched == [2]


def test_ngram_join_of_hot_classes(spark):
    """Classes of more and of fewer copies than are joined by broadcast, empty texts among them."""
    one, two = (" ".join(f"{w}{n}" for n in range(40)) for w in ("a", "b"))
    rows = [(i, one) for i in range(10, 1300)] + [(i, two) for i in range(2000, 2030)] + [(i, "") for i in range(3000, 4200)] + [(5, one.replace("a3 ", "x ")), (6, two + " y")]
    got = {r.doc_id: r.component_id for r in ngramjoin.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 5 if 10 <= i < 1300 else 6 if 2000 <= i < 2030 else i for i, _ in rows}


def test_ngram_join_edges(empty, nulls):
    assert ngramjoin.ngram_join(empty).collect() == []
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in ngramjoin.ngram_join(nulls).collect())
    assert got == [(0, 0, 0), (0, 2, 0), (1, 2, 1), (1, 2, 1)]


@pytest.mark.parametrize("seed", range(5))
def test_trie(seed):
    r = random.Random(seed)
    base = [r.sample(range(60), r.randrange(1, 30)) for _ in range(6)]
    sets = []
    for _ in range(60):
        s = set(base[r.randrange(6)])
        for _ in range(r.randrange(4)):
            s.symmetric_difference_update({r.randrange(60)})
        sets.append(np.array(sorted(s), np.uint64))
    got = {(int(p), s) for probes, s in trie.links(sets) for p in probes if p != s}
    both = lambda a, b: len(np.intersect1d(sets[a], sets[b]))
    want = {(a, b) for a in range(60) for b in range(60) if a != b and both(a, b) and 180 * both(a, b) >= 80 * (len(sets[a]) + len(sets[b]))}
    assert got == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


# ---------------------------------------------------------------- 4 media


def test_media(docs, texts, empty):
    rows = media.read_media(media.to_media(docs)).collect()
    stored = {r.doc_id: bytes(r.media) for r in media.to_media(docs).collect()}
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        full = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        assert media.payload_of(stored[r.doc_id]) == full
        assert (r.media_bytes, r.media_sha256) == (len(stored[r.doc_id]), hashlib.sha256(stored[r.doc_id]).hexdigest())
        assert r.fingerprint == sorted(r.fingerprint)
    assert media.media_features(empty).collect() == []


def brute_fingerprint(samples):
    """Frame by frame: a plain Fourier sum, the strongest bin of each band, pairs of peaks."""
    x = [float(v) - 128 for v in samples]
    frames = max(1, -(-(len(x) - media.FRAME) // media.HOP) + 1)
    x += [0.0] * ((frames - 1) * media.HOP + media.FRAME - len(x))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(media.FRAME) / (media.FRAME - 1))
    wave = np.exp(-2j * np.pi * np.outer(np.arange(512), np.arange(media.FRAME)) / media.FRAME)
    found = []
    for t in range(frames):
        power = np.abs(wave @ (window * np.array(x[t * media.HOP : t * media.HOP + media.FRAME])))
        best = [max(range(a, b), key=lambda k: power[k]) for a, b in zip(media.BANDS, media.BANDS[1:])]
        mean = sum(power[k] for k in best) / len(best)
        found += [(t, k) for k in best if power[k] > media.STANDS_OUT * mean]
    codes = []
    for i, (t, f) in enumerate(found):
        codes += [t << 24 | f << 15 | g << 6 | u - t for u, g in found[i + 1 : i + 1 + media.FAN] if u - t <= media.REACH]
    return sorted(codes)


def test_media_fingerprints(docs, texts):
    got = {r.doc_id: r for r in media.media_features(docs).collect()}
    for i in (0, 70, 140, 175, 190, 191, 193, 199):
        data = (texts[i] or "").encode()
        assert got[i].fingerprint == brute_fingerprint(data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))), i
        assert got[i].n_pairs == len(got[i].fingerprint)
        assert got[i].feature == f"{got[i].n_pairs}:{hashlib.sha256(b''.join(struct.pack('<q', c) for c in got[i].fingerprint)).hexdigest()[:32]}"


def test_peaks_find_a_tone():
    t = np.arange(8000)
    tone = (128 + 100 * np.sin(2 * np.pi * 1100 * t / media.RATE)).astype(np.uint8)
    _, bins = media.peaks(tone)
    assert Counter(bins.tolist()).most_common(1)[0][0] == round(1100 * media.FRAME / media.RATE)  # bin 141, away from the edge of a band


# ---------------------------------------------------------------- 5 toxicity


def test_toxicity_learns_and_spares():
    """Held-out accuracy; with a few hundred examples of either label. Measured: 174 of 200 toxic texts found; the floor is 160,
    so this guards against a model that doesn't learn, not against a few misses."""
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 8))) for _ in range(3000)]
    bad = ["rotten", "vermin", "filthy", "wretch"]
    text = lambda: [r.choice(vocabulary) for _ in range(r.randrange(5, 80))]
    clean, toxic = [" ".join(text()) for _ in range(700)], []
    for _ in range(600):
        w = text()
        for _ in range(2):
            w.insert(r.randrange(len(w)), r.choice(bad))
        toxic.append(" ".join(w))
    m = toxicity.train(clean[:500] + toxic[:400], [0] * 500 + [1] * 400)
    score = lambda t: m.logit(m.words(toxicity.words_of(t)))
    assert sum(score(t) > 0.85 for t in toxic[400:]) >= 160
    assert sum(score(t) > 0.85 for t in clean[500:]) <= 10
    assert score("SOME v3rmin here") == score("some v3rmin here")


def brute_score(m, text):
    """Word by word and window by window, from the model's weights."""

    def word(w):
        raw = f"<{w}>".encode()
        at = [zlib.crc32(raw) >> 15]
        for n in toxicity.NGRAMS:
            for i in range(len(raw) - n + 1):
                h = n
                for c in raw[i : i + n]:
                    h = (h ^ c) * 0x01000193 % 2**32
                at.append((h * 0x9E3779B1 % 2**32) >> 15)
        return sum(float(m.weights[k]) for k in at) / len(at)

    words = list(dict.fromkeys(re.findall(r"[^\W_]+", (text or "").lower())))
    n = len(words)
    starts = {*range(0, max(1, n - toxicity.WINDOW + 1), toxicity.STRIDE), max(0, n - toxicity.WINDOW)}
    score = [word(w) for w in words]
    means = [sum(score[s : s + toxicity.WINDOW]) / len(score[s : s + toxicity.WINDOW]) for s in starts] if words else [0.0]
    return 1 / (1 + math.exp(-(m.bias + max(means))))


def test_toxicity_scores(docs, texts):
    """Scores of all documents against brute force, with a model whose weights are all different."""
    m = toxicity.Model(np.random.default_rng(2).normal(size=toxicity.BUCKETS).astype(np.float32), -0.4)
    for r in toxicity.score_toxicity(docs, m).collect():
        want = brute_score(m, texts[r.doc_id])
        assert math.isclose(r.score, want, rel_tol=1e-9) and r.predicted == (want >= 0.7), r.doc_id


def test_toxicity_query(spark, small):
    """The registered query: folds, and scores as the model gives them that was trained on the same rows."""
    from quern.llm.queries import op5_toxicity

    docs = spark.read.parquet(f"{small}/documents.parquet")
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 3
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    learn = sorted((label[r.doc_id], r.doc_id, r.text) for r in docs.collect() if fold(r.doc_id) != 1 and label.get(r.doc_id) is not None)
    m = toxicity.train([t for *_, t in learn], [y for y, *_ in learn])
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = op5_toxicity(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute_score(m, texts[r.doc_id])
        assert r.held_out == (fold(r.doc_id) == 1) and math.isclose(r.score, want, rel_tol=1e-6) and r.predicted == (r.score >= 0.7)


def test_toxicity_edges(spark, docs, empty, nulls):
    m = toxicity.train(["a", None, ""], [0, 0, 0])
    rows = toxicity.score_toxicity(docs, m).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == 0 for r in rows)
    assert set(toxicity.score_toxicity(docs, m).columns) == {*docs.columns, "predicted"}
    assert toxicity.score_toxicity(empty, m).collect() == []
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, None), (None, 1), (999, 1)], "doc_id long, toxic int")
    assert sorted(toxicity.training_rows(docs, labels)[1]) == [0, 1]
    assert toxicity.training_rows(empty, labels) == ([], [])
    assert toxicity.score_toxicity(nulls, m).count() == 4


# ---------------------------------------------------------------- 6 line dedup


def brute_lines(texts):
    lines = {i: [x.strip(" \t\n\x0b\f\r") for x in t.split("\n")] for i, t in texts.items() if t is not None}
    full = {i: [x for x in xs if x] for i, xs in lines.items()}
    first, gone = {}, defaultdict(set)
    for i in sorted(full):
        for p in range(len(full[i]) - 2):
            at = first.setdefault(tuple(full[i][p : p + 3]), (i, p))
            if at != (i, p):
                gone[i] |= set(range(max(p, at[1] + 3) if at[0] == i else p, p + 3))
    out = {}
    for i, t in texts.items():
        if t is None:
            out[i] = (None, 0, 0)
            continue
        kept, n = [], 0
        for raw, x in zip(t.split("\n"), lines[i]):
            if not x or n not in gone[i]:
                kept.append(raw)
            n += bool(x)
        out[i] = ("\n".join(kept), len(full[i]), len(gone[i]))
    return out


def test_line_dedup(docs, texts, empty, nulls):
    got = {r.doc_id: (r.text, r.n_lines, r.removed_lines) for r in linededup.dedup_lines(docs).collect()}
    want = brute_lines(texts)
    assert got == want and any(w[2] for w in want.values())
    assert linededup.dedup_lines(empty).collect() == []
    assert linededup.dedup_lines(nulls).count() == 4
    assert {"size", "score"} <= set(linededup.dedup_lines(nulls).columns)


# ---------------------------------------------------------------- 7 token counts


def test_rollup(spark, tmp_path, nulls):
    r = rollup.TokenRollup(spark, f"file://{tmp_path}/r")
    assert r.totals().collect() == []
    make = lambda *rows: spark.createDataFrame(rows, "source string, lang string, n long")
    r.commit("1", rollup.changes(make(("a", "en", 5), ("a", "en", 7), (None, None, None)), "v1", F.col("n")))
    r.commit("2", rollup.changes(make(("a", "en", 5)), "v1", F.col("n"), -1))
    r.commit("2", rollup.changes(make(("a", "en", 5)), "v1", F.col("n"), -1))
    r.commit("3", rollup.revisions(make(("a", "en", 7)), "v1", F.col("n"), F.lit(9)))
    want = {("a", "en", "v1", 1, 9), (None, None, "v1", 1, 0)}
    assert {tuple(x) for x in r.totals().collect()} == want
    r.compact("4")
    assert r.batches() == ["4"] and {tuple(x) for x in r.totals().collect()} == want
    with pytest.raises(ValueError):
        r.compact("4")
    r.commit("5", rollup.changes(nulls.limit(0), "v1", F.lit(1)))
    assert {tuple(x) for x in r.totals().collect()} == want
    assert rollup.changes(nulls, "v", rollup.words_of(F.coalesce("text", F.lit("")))).agg(F.sum("tokens")).first()[0] == 18


def test_rollup_retries_after_compaction(spark, tmp_path, monkeypatch):
    r = rollup.TokenRollup(spark, f"file://{tmp_path}/r")
    make = lambda n: rollup.changes(spark.createDataFrame([("a", "en", n)], "source string, lang string, n long"), "v", F.col("n"))
    assert r.commit("1", make(5)) and r.commit("2", make(7))
    r.compact("3")
    assert not r.commit("2", make(7))
    with pytest.raises(ValueError):
        r.commit("3", make(1))
    total = lambda: {tuple(x)[3:] for x in r.totals().collect()}
    assert r.batches() == ["3"] and total() == {(2, 12)}
    assert r.commit("4", make(1))
    r.compact("5")
    assert not any(r.commit(b, make(7)) for b in "124") and total() == {(3, 13)}
    with pytest.raises(ValueError):
        r.compact("2")


@pytest.mark.parametrize("at", ["_publish", "_drop"])
def test_rollup_survives_a_crash(spark, tmp_path, monkeypatch, at):
    """Between what a compaction writes and its manifest, and between that and the deletes; and in a commit."""
    r = rollup.TokenRollup(spark, f"file://{tmp_path}/r")
    make = lambda n: rollup.changes(spark.createDataFrame([("a", "en", n)], "source string, lang string, n long"), "v", F.col("n"))
    r.commit("1", make(5))
    r.commit("2", make(7))

    def crash(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(rollup.TokenRollup, at, crash)
        with pytest.raises(OSError):
            r.compact("3")
        if at == "_drop":
            with pytest.raises(OSError):
                r.commit("4", make(1))
                r.commit("4", make(1))
    total = lambda: {tuple(x)[3:] for x in r.totals().collect()}
    want = {(2, 12)} if at == "_publish" else {(3, 13)}
    assert total() == want
    for b, n in (("1", 5), ("2", 7)):
        r.commit(b, make(n))
    assert total() == want
    if at == "_publish":
        r.compact("3")
    r.compact("9")
    assert r.batches() == ["9"] and total() == want
    (tmp_path / "r" / "batch=8" / "try=1").mkdir(parents=True)  # a commit that never ended
    assert total() == want and r.commit("8", make(2)) and total() == {(a + 1, b + 2) for a, b in want}


# ---------------------------------------------------------------- 8 context-tree weighting


def brute_ctw(train, texts, depth):
    """Codes of texts under trees in plain dictionaries."""
    counts = defaultdict(lambda: [0, 0])
    pad = b"\xff" * depth

    def steps(t):
        b = pad + t.lower() + b"\xff"
        for i in range(depth, len(b)):
            for j in range(8):
                yield b[i - depth : i], 1 << j | b[i] >> (8 - j), b[i] >> (7 - j) & 1

    for t in train:
        for c, node, bit in steps(t):
            for d in range(depth + 1):
                counts[c[depth - d :], node][bit] += 1
    kt = lambda z, o: math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)
    weight, both, below = {}, {}, defaultdict(float)
    for c, node in sorted(counts, key=lambda k: -len(k[0])):
        own = kt(*counts[c, node])
        if len(c) == depth:
            weight[c, node], both[c, node] = 1.0, own
        else:
            a, b = own, below[c, node]
            both[c, node] = max(a, b) + math.log1p(math.exp(-abs(a - b))) - math.log(2)
            weight[c, node] = math.exp(own - math.log(2) - both[c, node])
        if c:
            below[c[1:], node] += both[c, node]
    scores = []
    for text in texts:
        total = 0.0
        for c, node, bit in steps(text):
            p = None
            for d in range(depth, -1, -1):
                key = c[depth - d :], node
                n = counts.get(key)
                if n is None:
                    continue
                est = (n[bit] + 0.5) / (sum(n) + 1)
                p = est if p is None else weight[key] * est + (1 - weight[key]) * p
            total += math.log10(0.5 if p is None else p)
        scores.append(total)
    return scores


@pytest.mark.parametrize("shape", [{}, {"CHUNK": 4000, "BLOCK": 500, "MERGE": 50, "ROW": 100, "ASKED": 300, "MEMO": 1000}])
def test_ctw(docs, texts, monkeypatch, shape):
    """One chunk for each task, and then many of them: the long text in pieces, counts merged and questions answered in parts."""
    for k, v in shape.items():
        monkeypatch.setattr(ctw, k, v)
    got = {r.doc_id: r for r in ctw.score_corpus(docs, depth=3).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    train = [(texts[i] or "").encode() for i in held if not held[i]]
    c = Counter()
    for i in held:
        if not held[i]:
            c.update([*WORDS.findall(lower(texts[i])), "\0end"])
    n, v = sum(c.values()), len(c)
    for i, r in got.items():
        w = [*WORDS.findall(lower(texts[i])), "\0end"]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(x in c for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert math.isclose(r.bits_per_byte, -r.score * math.log2(10) / (len((texts[i] or "").encode()) + 1), rel_tol=1e-9)
    some = [3, 70, 150, 190, 191, 193, 197, *(i for i in held if held[i])]
    want = brute_ctw(train, [(texts[i] or "").encode() for i in some], 3)
    for i, w in zip(some, want):
        assert math.isclose(got[i].score, w, rel_tol=1e-5), i


def test_ctw_depths(docs, texts):
    """Fewer bytes of context than deal strings to buckets, as many, and more."""
    some = docs.where("doc_id between 60 and 90")
    train = [(texts[i] or "").encode() for i in range(60, 91) if zlib.crc32(str(i).encode()) % 7 != 2]
    for depth in (0, 1, 5):
        got = {r.doc_id: r.score for r in ctw.score_corpus(some, depth=depth).collect()}
        want = brute_ctw(train, [texts[i].encode() for i in range(60, 91)], depth)
        assert all(math.isclose(got[i], w, rel_tol=1e-5) for i, w in zip(range(60, 91), want)), depth


def test_ctw_pieces():
    r = random.Random(1)
    long = b" ".join(bytes(r.choices(b"abc", k=r.randrange(1, 9))) for _ in range(500))
    texts = [b"", b"ab", long, b"x" * 3000, b"\n" * 900, long[:101]]
    for size in (10, 100, 10**6):
        parts = list(ctw.blocks(texts, 4, size))
        whole = list(ctw.blocks(texts, 4, 10**9))
        g = [np.concatenate([ctw.strings(p, 4)[0] for p in ps]) for ps in (parts, whole)]
        w = [np.concatenate([ctw.block_words(p)[0] for p in ps]) for ps in (parts, whole)]
        assert (g[0] == g[1]).all() and (w[0] == w[1]).all() and len(g[0]) == sum(len(t) + 1 for t in texts)


def test_ctw_edges(empty, nulls):
    assert ctw.score_corpus(empty).collect() == []
    rows = ctw.score_corpus(nulls).collect()
    assert len(rows) == 4 and all(r.score < 0 for r in rows)


@pytest.mark.parametrize("zeros", [0, 1])
def test_ctw_keeps_a_rare_bit_after_many(zeros):
    context = int.from_bytes(b" the ", "big") << 8
    g = np.array([context | 0x60, context | 0x61], np.uint64)  # they differ in the last bit
    counts = np.array([zeros, 10**8])
    n = 10**8 + zeros
    trees = ctw.Trees(g[counts > 0], counts[counts > 0], 5, ctw.Nodes())
    # all depths have the same counts; the seven bits before are seen n times
    before = 7 * math.log10((n + 0.5) / (n + 1))
    want = [before + math.log10((c + 0.5) / (n + 1)) for c in (zeros, 10**8)]
    assert np.allclose(trees.log10(g), want, rtol=1e-6, atol=1e-9)
    assert np.allclose(ctw.unsigned(ctw.signed(np.array([1e-12, 1 - 1e-12]), np.array([1 - 1e-12, 1e-12]))), [[1e-12, 1 - 1e-12], [1 - 1e-12, 1e-12]], rtol=1e-6, atol=0)


def test_distinct():
    g = np.random.default_rng(1).integers(0, 5000, 100_000).astype(np.uint64) * np.uint64(977)
    k, c = ctw.distinct(g)
    assert dict(zip(k.tolist(), c.tolist())) == Counter(g.tolist())


# ---------------------------------------------------------------- 9 winnowing


def brute_winnow(text, k=winnowing.K, w=winnowing.W):
    """(value, position) of the chosen grams, one at a time."""
    import xxhash

    h = [(xxhash.xxh64_intdigest(x.encode(), seed=42) >> 29) % winnowing.PRIME for x in WORDS.findall(text.lower())]
    if not h:
        return []
    h += [0] * (k - len(h))
    roll, values = 0, []
    for i, x in enumerate(h):
        roll = (roll * winnowing.BASE + x - (h[i - k] * winnowing.BASE**k if i >= k else 0)) % winnowing.PRIME
        if i >= k - 1:
            values.append(roll)
    out = []
    for a in range(max(1, len(values) - w + 1)):
        part = values[a : a + w]
        at = a + max(j for j, y in enumerate(part) if y == min(part))
        if not out or out[-1][1] != at:
            out.append((values[at], at))
    return out


def test_winnowing(spark, docs, texts):
    got = {r.doc_id: r for r in winnowing.fingerprint_edits(docs).collect()}
    ids = sorted(texts, reverse=True)

    def digest(chosen):
        return f"{len(chosen)}:{hashlib.md5(','.join(f'{v << 28 | (2**28 - 1 - p):X}' for v, p in chosen).encode()).hexdigest()}"

    def near(a, b):
        a, b = {v for v, _ in a}, {v for v, _ in b}
        return len(a & b) / len(a | b) if a | b else 1.0

    for k, i in enumerate(ids):
        text, follow = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + follow[:cut]
        own, changed, after = map(brute_winnow, (text, edited, follow))
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (digest(own), digest(changed))
        assert math.isclose(got[i].near_edited, near(own, changed)) and math.isclose(got[i].near_next, near(own, after))
    assert got[194].fingerprint == got[195].fingerprint and got[195].near_next == 1.0


@pytest.mark.parametrize("block", [4096, 3])
def test_next_document(docs, texts, nulls, monkeypatch, block):
    monkeypatch.setattr(winnowing, "BLOCK", block)
    ids = sorted(texts, reverse=True)
    small = {r.doc_id: r.next_text for r in winnowing.with_next(docs, group_rows=7).collect()}
    assert small == {i: texts[ids[(k + 1) % len(ids)]] or "" for k, i in enumerate(ids)}
    got = sorted((r.doc_id or 0, r.text, r.next_text) for r in winnowing.with_next(nulls, group_rows=1).collect())
    same = "a b c d e f"
    assert got == [(0, "", same), (0, same, same), (1, same, ""), (1, same, same)] or got == [(0, "", same), (0, same, same), (1, same, same), (1, same, "")]


@pytest.mark.parametrize(("k", "w"), [(1, 1), (2, 3), (3, 5), (5, 4), (7, 9)])
def test_winnow_of_other_sizes(spark, texts, k, w):
    some = [t for t in texts.values() if t and len(t) < 3000][::4]
    rows = spark.createDataFrame([(t,) for t in some], "t string").select("t", winnowing.winnow(F.col("t"), k, w).alias("c"))
    for r in rows.select("t", winnowing.positions(F.col("c")).alias("p"), F.transform("c", lambda c: F.shiftrightunsigned(c, 28)).alias("v")).collect():
        assert list(zip(r.v, r.p)) == brute_winnow(r.t, k, w)


def test_winnowing_edges(empty, nulls):
    assert winnowing.fingerprint_edits(empty).collect() == []
    assert winnowing.fingerprint_edits(nulls).count() == 4


# ---------------------------------------------------------------- 10 mixing


def test_mixing(docs, texts):
    rows = mixing.mix(docs).collect()
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}
    source = {r.doc_id: r.source for r in docs.collect()}
    size = {i: len(WORDS.findall(t or "")) for i, t in texts.items()}
    sums = defaultdict(int)
    for i, n in size.items():
        sums[source[i]] += n
    names = sorted((s for s in sums if s is not None)) + [None]
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, target = set(names), {}
    total = 1.5 * sum(sums.values())
    while True:
        share = (total - sum(target.values())) / sum(weights[s] for s in left)
        over = {s for s in left if share * weights[s] > 2 * sums[s]}
        if not over:
            break
        target |= {s: 2.0 * sums[s] for s in over}
        left -= over
    target |= {s: share * weights[s] for s in left}
    taken = defaultdict(int)
    for r in rows:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], sums[s]) and math.isclose(r.target, target[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)


def test_mixing_edges(empty, nulls):
    assert mixing.mix(empty).collect() == []
    assert mixing.mix(nulls, keep=["text", "n"]).count() == 4
