"""Parsing, filters, aggregation and output over small logs, held against plain Python."""

import random
import re

import pytest
import zstandard
from pyspark.sql import functions as F

from quern.functions import logfmt, rows, times
from quern.operators import aggregates as agg
from quern.operators import slicing as cut
from quern.plans.durations import parse_rfc3339
from quern.plans.planner import Engine
from quern.plans.query import Query
from quern.sources import logs

#: The standard fixture's level counts, for seed 42.
GOLDEN = {"debug": 54, "info": 51, "error": 49, "warn": 43, "critical": 3}


def scan(line):
    """The grammar as a plain scanner."""
    out, i, n = [], 0, len(line)
    while i < n:
        if line[i] == " ":
            i += 1
        elif line[i] == "=":
            while i < n and line[i] != " ":
                i += 1
        else:
            j = i
            while j < n and line[j] not in "= ":
                j += 1
            key, i = line[i:j], j
            if i >= n or line[i] != "=":
                out.append((key, ""))
                continue
            i += 1
            j = i
            if i < n and line[i] == '"':
                j = i + 1
                while j < n and line[j] != '"':
                    j += 2 if line[j] == "\\" else 1
                j = min(j + 1, n)
            else:
                while j < n and line[j] != " ":
                    j += 1
            out.append((key, line[i:j]))
            i = j
    return out[:256]


def plain(v):
    if not v.startswith('"'):
        return v
    out, i = "", 1
    while i < len(v):
        if v[i] == "\\":
            if i + 1 < len(v):
                out += {"n": "\n", "r": "\r", "t": "\t"}.get(v[i + 1], v[i + 1])
            i += 2
        elif v[i] == '"':
            break
        else:
            out += v[i]
            i += 1
    return out


def frame(spark, texts):
    return logs.parsed(logs.with_raw(logs.lines(spark, texts)))


def output(engine, **options):
    return [r["line"] for part in engine.output(Query(**options)) for r in part.collect()]


@pytest.fixture(scope="module")
def standard():
    """200 lines, ten a second, in the order of draws that the golden counts come from."""
    r = random.Random(42)
    levels, messages = ["debug", "info", "warn", "error"], [f"message {i}" for i in range(9)]
    out = []
    for i in range(200):
        level = "critical" if r.random() <= 0.01 else r.choice(levels)
        msg = r.choice(messages)
        out.append(f'time=2026-04-24T18:00:{i // 10:02d}.{i % 10}00000Z level={level} msg="{msg}"')
    return out


@pytest.fixture(scope="module")
def standard_file(standard, tmp_path_factory):
    path = tmp_path_factory.mktemp("logs") / "app.log"
    path.write_text("\n".join(standard) + "\n")
    return str(path)


def test_scanner_and_values(spark):
    r = random.Random(1)
    texts = ["", " ", "a", "a=", "=x b=1", 'k="a"b=c', 'k="a', 'k="a\\', "a=b=c", 'm="say \\"hi\\"" x', "\ttab=1", "é=ü 😀=\"x y\"", " ".join(f"k{i}=v" for i in range(300))]
    texts += ["".join(r.choice('ab= "\\n\t\r') for _ in range(r.randrange(30))) for _ in range(1500)]
    df = frame(spark, texts).select("raw", "pairs", "overflow", F.transform("pairs", lambda p: logfmt.unescape(p["v"])).alias("plain"))
    for row in df.collect():
        want = scan(row.raw)
        assert [(p.k, p.v) for p in row.pairs] == want, row.raw
        assert row.plain == [plain(v) for _, v in want], row.raw
        assert row.overflow == (len(row.raw.split()) == 300)


def test_first_value_of_line(spark):
    many = "=junk " * 5 + " ".join(f"k{i}=v{i}" for i in range(300))
    df = frame(spark, ['a=1 a=2 b="x y"', "b=1", many])
    for key in ("a", "b", "k255", "k256"):
        got = df.select(logfmt.first_value_of_line(F.col("raw"), key).alias("x"), logfmt.first_value(F.col("pairs"), key).alias("y")).collect()
        assert [r.x for r in got] == [r.y for r in got]


def test_escape_round_trip(spark):
    r = random.Random(2)
    texts = ["", "plain", "a b", 'q"q', "\\", "\n\r\t", "\x01", "é"] + ["".join(r.choice('x= "\\\n\r\té\x02') for _ in range(r.randrange(12))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    got = df.select("v", logfmt.unescape(logfmt.escape(F.col("v"))).alias("back"), logfmt.escape(F.col("v")).alias("raw")).collect()
    assert all(x.v == x.back for x in got)
    assert {x.v: x.raw for x in got}["plain"] == "plain"
    assert {x.v: x.raw for x in got}[""] == '""'


def test_times_in_and_out(spark):
    texts = ["1970-01-01T00:00:00Z", "2026-04-24 18:00:00.123456789+02:00", "2026-04-24T18:00:00-0330", "2024-02-30T00:00:00Z", "1969-12-31T23:59:59.5Z", "1677-09-21T00:12:43.145224193Z", "x", "2262-04-11T23:47:16.854775807Z", "2262-04-11T23:47:16.854775808Z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("ns", times.parse_ns(F.col("t")))
    got = {r.t: r.ns for r in df.collect()}
    assert got == {t: parse_rfc3339(t) for t in texts}
    row = spark.createDataFrame([(1_777_046_400_120_000_000,), (0,), (-1,)], "ns long").select("ns", times.format_ns(F.col("ns")).alias("u"), times.format_ns(F.col("ns"), "Europe/Berlin").alias("b"), times.format_ns(F.col("ns"), "-03:30").alias("o"))
    assert [tuple(r)[1:] for r in row.collect()] == [
        ("2026-04-24T16:00:00.12Z", "2026-04-24T18:00:00.12+02:00", "2026-04-24T12:30:00.12-03:30"),
        ("1970-01-01T00:00:00Z", "1970-01-01T01:00:00+01:00", "1969-12-31T20:30:00-03:30"),
        ("1969-12-31T23:59:59.999999999Z", "1970-01-01T00:59:59.999999999+01:00", "1969-12-31T20:29:59.999999999-03:30"),
    ]


def test_first_time_pair_decides(spark):
    got = frame(spark, ["time=x ts=1970-01-01T00:00:01Z", "ts=1970-01-01T00:00:02Z time=y", 'time="1970-01-01 00:00:03"', "a=1"]).select("ts_ns").collect()
    assert [r.ts_ns for r in got] == [None, 2_000_000_000, 3_000_000_000, None]


@pytest.mark.parametrize(
    "line,expression,want",
    [
        ("level=warn", "level>=warning", True),
        ("level=ERR", "level>warn", True),
        ("level=banana", "level>=error", False),
        ("a=10", "a>9", True),
        ("a=10", 'a>"9"', True),
        ("a=x", "a>9", True),
        ("a=nan", "a<=1", True),
        ("a=nan", "a>1", False),
        ("a=1", "a>=nan", True),
        ("a=' 5'", "a>=5", False),
        ("a=1 a=2", "a=2", True),
        ("a=1 a=2", "a!=1", True),
        ("a=1 a=2", "not a=1", False),
        ("b=1", "a!=1", True),
        ("b=1", "a<5", False),
        ("a=", "exists a", True),
        ("a", "a=''", True),
        ('m="say \\"hi\\""', 'm=\'say \\\\"hi\\\\"\'', True),
        ("m=foobar", "m=~oba", True),
        ("m=foo", "m=~o$", True),
        ("", "a!=1", True),
    ],
)
def test_predicates(spark, line, expression, want):
    df = frame(spark, [line]).select(cut.matched(Query(where=(expression,)), (None, None)).alias("hit"))
    assert df.first().hit is want


def test_counts_match_the_golden_ones(spark, standard_file):
    got = output(Engine(spark, [standard_file]), count=True, group_by=("level",))
    assert {x.split()[1].split("=")[1]: int(x.split()[0].split("=")[1]) for x in got} == GOLDEN
    assert got[0].startswith("count=54 key.level=debug time.start=2026-04-24T18:00:")
    assert output(Engine(spark, [standard_file]), count=True) == ["200"]
    assert output(Engine(spark, [standard_file]), count=True, json=True) == ['{"count":200}']


def test_buckets(spark, standard_file):
    got = output(Engine(spark, [standard_file]), count=True, bucket="5s")
    assert [x.split()[0] for x in got] == ["count=50"] * 4
    assert [x.split()[1] for x in got] == [f"bucket.start=2026-04-24T18:00:{s:02d}Z" for s in (0, 5, 10, 15)]
    got = output(Engine(spark, [standard_file]), count=True, n_buckets=4)
    assert sum(int(x.split()[0].split("=")[1]) for x in got) == 200 and len(got) == 4


def test_several_files_are_their_concatenation(spark, standard, standard_file, tmp_path):
    (tmp_path / "a.log").write_text("\n".join(standard[:100]) + "\n")
    (tmp_path / "b.log").write_text("\n".join(standard[100:]))
    two = Engine(spark, [str(tmp_path / "a.log"), str(tmp_path / "b.log")])
    one = Engine(spark, [standard_file])
    for options in ({"count": True, "group_by": ("level",)}, {"where": ("level=error",), "limit": 30}, {"time_from": "start+8s", "time_to": "end-8s", "count": True}):
        assert output(two, **options) == output(one, **options)
    mixed = Engine(spark, [str(tmp_path / "a.log"), "-"], stdin=standard[100:])
    assert output(mixed, count=True) == ["200"]


def test_archives(spark, standard, standard_file, tmp_path):
    data = ("\n".join(standard) + "\n").encode()
    c = zstandard.ZstdCompressor()
    seekable = c.compress(data[:5000]) + c.compress(data[5000:]) + b"\x5e\x2a\x4d\x18" + (4).to_bytes(4, "little") + b"seek"
    for name in ("a.zstd", "a.seekztd"):
        (tmp_path / name).write_bytes(seekable)
        assert output(Engine(spark, [str(tmp_path / name)]), where=("level=error",)) == output(Engine(spark, [standard_file]), where=("level=error",))


def test_time_window(spark, standard_file):
    engine = Engine(spark, [standard_file])
    assert output(engine, time_from="18:00:05", time_to="2026-04-24T18:00:05.999999Z", count=True) == ["10"]
    assert output(engine, time_range=True) == ["2026-04-24T18:00:00Z .. 2026-04-24T18:00:19.9Z  (19s)"]


def test_rows_and_edits(spark):
    lines = ['a=1  b="x y" =junk flag', 'a=2 b="q\\"q" a=3']
    engine = Engine(spark, stdin=lines)
    assert output(engine) == lines
    assert output(engine, where=("exists a",)) == ['a=1 b="x y" flag=', 'a=2 b="q\\"q" a=3']
    assert output(engine, json=True) == ['{"a":"1","b":"x y","flag":""}', '{"a":"2","b":"q\\"q","a":"3"}']
    assert output(engine, remove=("a", "new"), add=(("new", "1"), ("c", "d e"))) == ['b="x y" flag= c="d e"', 'b="q\\"q" c="d e"']
    assert output(engine, raw_key="b") == ["x y", 'q"q']


def test_sort_limit_context(spark):
    lines = [f"n={i} k={'x' if i % 7 == 3 else 'y'}" + (f" s={(i * 5) % 11}" if i % 2 else "") for i in range(30)]
    engine = Engine(spark, stdin=lines)
    hits = [i for i in range(30) if i % 7 == 3]
    assert output(engine, where=("k=x",), limit=2) == [lines[i] for i in hits[:2]]
    assert output(engine, limit=0) == []
    want = sorted(range(6), key=lambda i: (str((i * 5) % 11) if i % 2 else "", i))
    assert output(engine, limit=6, sort_by="s") == [lines[i] for i in want]
    near = sorted({j for i in hits for j in range(i - 1, i + 3) if 0 <= j < 30})
    assert output(engine, where=("k=x",), before=1, after=2) == [lines[i] for i in near]
    assert output(engine, where=("k=x",), after=2, limit=1) == [lines[3]]


def test_lists_and_statistics(spark):
    lines = ["b=1 a=2", "a=1 a=9", "c", ""]
    engine = Engine(spark, stdin=lines)
    assert output(engine, list_keys=True) == ["a", "b", "c"]
    assert output(engine, list_values=("a",)) == ["1", "2"]
    assert output(engine, list_values=("a", "b")) == ["# a", "1", "2", "# b", "1"]
    assert output(engine, list_keys=True, json=True) == ['["a","b","c"]']
    s = engine.statistics(Query(where=("exists a",)))
    assert (s["lines"], s["matched"], s["pairs"], s["invalid_utf8"]) == (4, 2, 5, 0)


def test_invalid_utf8_is_counted_and_passed_over(spark, tmp_path):
    (tmp_path / "x.log").write_bytes(b"a=1\n\xff\xfe\na=2\r\n")
    engine = Engine(spark, [str(tmp_path / "x.log")])
    assert output(engine, count=True) == ["2"]
    assert engine.statistics(Query())["invalid_utf8"] == 1


def test_missing_and_empty_share_a_group(spark):
    df = agg.counted(frame(spark, ["a= b=1", "b=1", "a=x b=1"]), ("a",))
    assert {(r["key.a"], r["count"], r["time_start_ns"]) for r in df.collect()} == {("", 2, None), ("x", 1, None)}


def test_fill_adds_empty_buckets(spark):
    df = frame(spark, ["time=1970-01-01T00:00:00Z", "time=1970-01-01T00:00:09Z"])
    grid = agg.Grid(1_000_000_000, 0, 10)
    assert agg.counted(df, (), grid).count() == 2
    assert [r["count"] for r in agg.counted(df, (), grid, fill=True).orderBy("bucket_start_ns").collect()] == [1, *[0] * 8, 1]


def test_sampling(spark):
    df = frame(spark, [f"n={i}" for i in range(2000)])
    got = df.where(cut.sampled(Query(sample_rate=0.5, seed=3))).count()
    assert 850 < got < 1150
    assert df.where(cut.sampled(Query(sample_rate=0.0))).count() == 0
    assert df.where(cut.sampled(Query(sample_rate=0.0, sample_if="n<10"))).count() == 1990


def test_json_and_sizes(spark):
    row = spark.createDataFrame([(2**53 - 1,), (2**53,)], "n long").select(rows.json_count(F.col("n")).alias("x")).collect()
    assert [r.x for r in row] == [str(2**53 - 1), f'"{2**53}"']
    assert [rows.humanized(n) for n in (5, 1536, 5 << 20)] == ["5 B", "1.5 KiB", "5.0 MiB"]


def test_generated_log(spark):
    df = logs.generated(spark, 5000)
    assert df.count() == 5000
    levels = logs.parsed(logs.with_raw(logs.lines(spark, df))).select(cut.value_of("level").alias("l")).groupBy("l").count().collect()
    assert {r.l for r in levels} == {"debug", "info", "warn", "error", "critical"}


def test_ingest_keeps_lines(spark, standard_file, tmp_path):
    df = Engine(spark, [standard_file]).lines()
    logs.ingest(df, str(tmp_path / "table"), 2)
    back = spark.read.parquet(str(tmp_path / "table"))
    assert back.where("ts_ns >= 0").count() == 200


def test_what_is_found_in_the_line_is_what_the_pairs_hold(spark):
    """Filters, first values and times by one pattern over the line, against the same over its pairs."""
    import random

    from quern.functions.times import parse_ns
    from quern.plans.filters import parse, to_column

    r = random.Random(11)
    part = lambda: r.choice(["a", "b", "time", "ts", "a.b", "ab", "=", "==", " ", "  ", '"', '\\"', "\\", "x", "=x", '="x"', '="x y"', '="a=x"', '"x"', "é", "\t", "2026-01-02T03:04:05Z", '="2026-01-02T03:04:05.25Z"'])
    texts = ["".join(part() for _ in range(r.randrange(0, 14))) for _ in range(4000)]
    texts += [" ".join(f"k{i}=1" for i in range(n)) + " a=x time=2026-01-02T03:04:05Z" for n in (254, 255, 256, 257)] + ["=q " * 300 + "a=x ts=2026-01-02T03:04:05Z"]
    df = logs.parsed(spark.createDataFrame([(t,) for t in texts], "raw string"))
    raw, pairs = F.col("raw"), F.col("pairs")
    for key in ("a", "a.b", "é", "time", "", "a b", "a=x"):
        assert df.where(~logfmt.first_value_of_line(raw, key).eqNullSafe(logfmt.first_value(pairs, key))).count() == 0, key
    for text in ("a=x", "a!=x", "exists a", "not exists a.b", "a=é or é!=x", "a='=x'", "'a=x'=x", "'a b'!=x", "exists 'a=x'", 'a=""', "a='x y'", "a!='x y'", "a=~^x", "a=~y$", "a>x", "a<=x", "'a b'=~x", "time<2026-01-02T03:04:05Z"):
        assert df.where(to_column(parse(text), pairs, raw) != to_column(parse(text), pairs)).count() == 0, text
    first = F.get(F.filter(pairs, lambda p: p["k"].isin("time", "ts")), F.lit(0))["v"]
    assert df.where(~F.col("ts_ns").eqNullSafe(parse_ns(logfmt.strip_quotes(first)))).count() == 0
    assert df.where("ts_ns is not null").count() > 10


def test_usual_times_are_read_as_any_others(spark):
    from quern.functions.times import _any_form, parse_ns

    texts = [f"{day}T{clock}{frac}{zone}" for day in ("2026-02-28", "2025-02-29", "1677-09-21", "1600-01-01", "0000-01-01", "2262-04-12", "9999-12-31") for clock in ("00:00:00", "23:59:60", "24:00:00", "00:12:43") for frac in ("", ".", ".1", ".123456", ".145224193", ".000000001") for zone in ("Z", "z", "", "+01:00")]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.where(~parse_ns(F.col("t")).eqNullSafe(_any_form(F.col("t")))).count() == 0


@pytest.mark.parametrize(
    ("pattern", "text", "want"),
    [
        ("^[[:digit:]]+$", "123", True), ("^[[:digit:]]+$", "d:", False), ("[[:^alpha:]x]", "abc", False), ("[[:^alpha:]x]", "abx", True), ("[[:punct:]]", "a-b", True),
        ("(?m)a$", "a\nb", True), ("a$", "a\nb", False), ("(?m:a$)|z$", "z\nb", False), ("(?i)A\\x{42}c", "abC", True), ("\\u{e9}", "é", True), ("\\p{Greek}", "ω", True), ("\\p{^Greek}", "ω", False), ("[]a]+b", "]ab", True), ("[^]]", "]", False),
    ],
)
def test_regex_dialect(spark, pattern, text, want):
    from quern.plans.filters import java_regex

    assert spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(java_regex(pattern)).alias("hit")).first().hit is want


@pytest.mark.parametrize("pattern", ["(", ")", "[a", "a{2", "*a", "[[:nope:]]", "(?U)a", "(?>a)", "a\\"])
def test_bad_regexes(spark, pattern):
    from quern.plans.filters import FilterError, java_regex

    with pytest.raises(FilterError):
        java_regex(pattern)


def test_carriage_returns_stay(spark, tmp_path):
    (tmp_path / "x.log").write_bytes(b"a=1\r\nb=2\na=3\r\r\nb=4\r")
    engine = Engine(spark, [str(tmp_path / "x.log")])
    assert output(engine) == ["a=1\r", "b=2", "a=3\r\r", "b=4\r"]
    assert output(engine, where=("exists a",)) == ["a=1\r", "a=3\r\r"]
    assert output(engine, add=(("c", "x"),), limit=1) == ["a=1 c=x\r"]
    assert output(engine, where=("a=1",), json=True) == ['{"a":"1"}']
    assert output(engine, where=("a=1",), after=1) == ["a=1\r", "b=2"]


def test_colours(spark):
    engine = Engine(spark, stdin=['time=1 level="WARN" m="x y" n=', "level=Error level=info"])
    b, r, q = "\x1b[1m", "\x1b[0m", '\x1b[1;34m"\x1b[0m'
    assert output(engine, color=True) == [
        f"{b}time{r}=\x1b[34m1{r} {b}level{r}={q}{b}\x1b[33mWARN{r}{q} {b}m{r}={q}x y{q} {b}n{r}=",
        f"{b}level{r}={b}Error{r} {b}level{r}={b}info{r}",
    ]


def test_many_files_are_one_scan(spark, standard, standard_file, tmp_path):
    paths = []
    for k in range(10):
        paths.append(str(tmp_path / f"part {k}.log"))
        (tmp_path / f"part {k}.log").write_text("\n".join(standard[k * 20 : (k + 1) * 20]) + "\n")
    many, one = Engine(spark, paths), Engine(spark, [standard_file])
    assert many.read._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    for options in ({}, {"where": ("level=error",), "limit": 30}, {"time_from": "start+8s", "time_to": "end-8s", "count": True}, {"count": True, "n_buckets": 3}):
        assert output(many, **options) == output(one, **options)
    mixed = Engine(spark, [*paths[:4], "-", *paths[5:]], stdin=standard[80:100])
    assert output(mixed) == output(one)
    assert output(Engine(spark, [paths[0], *paths]), count=True) == ["220"]


def test_ingested_table_is_an_input(spark, standard_file, tmp_path):
    path = str(tmp_path / "table.lines")
    one = Engine(spark, [standard_file])
    logs.ingest(one.lines(), path, 3)
    table = Engine(spark, [path])
    for options in ({}, {"where": ("level=error",)}, {"time_from": "start+8s", "time_to": "end-8s"}, {"count": True, "bucket": "5s"}):
        assert output(table, **options) == output(one, **options)
    plan = table.matched(Query(time_from="2026-04-24T18:00:05Z"))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts_ns," in plan
    assert output(Engine(spark, [path, standard_file]), count=True) == ["400"]


def test_long_standard_input_is_spooled(spark, standard, monkeypatch):
    monkeypatch.setattr(logs, "SPOOL", 30)
    assert output(Engine(spark, stdin=iter(standard))) == standard


def test_dashboard_text(spark):
    from quern.functions.terminal import GROWING, RISING, bar, sparkline

    def cells(values, width):
        values = values[-width:] if width > 0 else []
        return "".join(RISING[min(8, round(v / (max(values) or 1) * 8))] for v in values)

    for values in ([], [0, 0], [1, 2, 3, 16, 5], list(range(40))):
        for width in (0, 1, 3, 50):
            df = spark.createDataFrame([(values,)], "v array<long>")
            assert df.select(sparkline(F.col("v"), width).alias("x")).first().x == cells(values, width)
    for value, top, width, want in ((0, 10, 4, " "), (10, 10, 4, "████"), (5, 8, 3, "█▉"), (1, 0, 3, ""), (1, 2, 0, "")):
        assert spark.createDataFrame([(value, top)], "v long, t long").select(bar(F.col("v"), F.col("t"), width).alias("x")).first().x == want, (value, top, GROWING)
    rows = agg.classified(frame(spark, ["count=12 key.b=x key.a='y time.start=2026-01-01T00:00:00Z", "count=x", "a=1 count=2", ""])).collect()
    assert [r["count"] for r in rows] == [12, None, None, None]
    assert [(p.key, p.value) for p in rows[0].combo] == [("a", "'y"), ("b", "x")] and rows[0].time_start_ns == 1767225600 * 10**9


@pytest.mark.parametrize("ends", ["", "\n"])
def test_seekable_archives_are_split_by_their_tables(spark, tmp_path, ends):
    """Frames cut anywhere: within lines, at line ends, over lines that span several frames; every line once and in order."""
    import struct

    from quern.sources import seekable

    r = random.Random(4)
    for case in range(6):
        lines = ["x" * r.choice([0, 1, 5, 40, 300]) + str(i) for i in range(120)]
        data = ("\n".join(lines) + ends).encode()
        cuts = sorted({0, len(data), *(r.randrange(len(data)) for _ in range(case * 12)), *([i + 1 for i, c in enumerate(data) if c == 10][:: 9 if case % 2 else 200])})
        parts = [data[a:b] for a, b in zip(cuts, cuts[1:])]
        packed = [zstandard.ZstdCompressor().compress(p) for p in parts]
        table = b"".join(struct.pack("<II", len(c), len(p)) for c, p in zip(packed, parts))
        frame = struct.pack("<II", seekable.SKIPPABLE, len(table) + 9) + table + struct.pack("<IBI", len(parts), 0, seekable.FOOTER)
        path = tmp_path / f"{case}.seekztd"
        path.write_bytes(b"".join(packed) + frame)
        for split in (1, 200, 10**9):
            reader = seekable.SeekableReader({"path": str(path), "split": str(split)})
            runs = reader.partitions()
            assert split > 1 or len(runs) == len(parts)
            got = [x.decode() for run in runs for batch in reader.read(run) for x in batch.column(1).to_pylist()]
            assert got == lines, (case, split)
        if case == 3:
            assert output(Engine(spark, [str(path)])) == lines


def test_runs_of_backslashes_are_decoded_from_their_left(spark):
    """Escapes as pairs from the left, whatever stands behind them; a backslash at the very end is dropped."""
    def plain(v):
        body = v[1:-1] if re.fullmatch(r'"[^"\\]*(?:\\.[^"\\]*)*"', v, re.DOTALL) else v[1:]
        return re.sub(r"\\(.?)", lambda m: {"n": "\n", "r": "\r", "t": "\t"}.get(m[1], m[1]), body, flags=re.DOTALL)

    ends = ["", "n", "r", "t", "x", "0", "ä", "\U0001f600", "nn", "\n"]
    bodies = [a + "\\" * i + b + "\\" * j + c for a in ("", "n") for i in range(5) for b in ends for j in range(5) for c in ("", "t", 'e"')]
    texts = [f'"{x}' for x in bodies] + [f'"{x}"' for x in bodies]
    got = spark.createDataFrame([(t,) for t in texts], "v string").select("v", logfmt.unescape(F.col("v")).alias("plain")).collect()
    assert [(r.v, r.plain) for r in got if r.plain != plain(r.v)] == []


@pytest.mark.parametrize("name", ["parse_roundtrip_docs", "parse_roundtrip_pages"])
def test_long_values_are_found_and_made_once(spark, small, name):
    """One search in a line for each value and one line made for each row, filters included."""
    from quern.plans import registry

    df = registry.QUERIES[name](spark, small)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == len(df.columns) - 1
    assert plan.count("concat_ws(") == 1


def test_lines_of_a_filter_are_made_and_searched_once(spark, small):
    """The filter's value is found by one search, besides the two of the pattern for a key that a line has twice."""
    from quern.plans import registry

    plan = registry.QUERIES["lineitem_log_pricing"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("date_format(") == plan.count("concat_ws(") == 1
    assert plan.count("((?:flag)(?=") == plan.count("((?:status)(?=") == plan.count("((?:qty)(?=") == 1


@pytest.mark.parametrize("test", ["aa>=5", "aa<5", "aa=~'^[5-9x]'", "aa>=m", "aa<=error"])
def test_repeated_keys_are_told_from_repeated_text(spark, test):
    from quern.plans.filters import parse, to_column

    texts = ["aa=1 aa=9", "aa=9 aa=1", "aaa=9 aa=1", "aa=1 m=aa", "aaaa=7", "aa aa=6", "aa=x aa=7", "aa=info aa=fatal", 'm="aa=9" aa=1', 'aa="1" aa="9"', "aa=nan", "b=1", "aa=aa aa=aa"]
    df = frame(spark, texts)
    got = df.select("raw", to_column(parse(test), F.col("pairs"), F.col("raw")).alias("x"), to_column(parse(test), F.col("pairs")).alias("y")).collect()
    assert [(r.raw, r.x) for r in got] == [(r.raw, bool(r.y)) for r in got]
