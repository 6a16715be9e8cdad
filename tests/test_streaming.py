"""Buckets that close, and files that grow, are replaced, or end within a line."""

import os
import pickle
import time

import pytest
from pyspark.sql import functions as F

from quern.plans.query import Query
from quern.sources import logs
from quern.streaming.buckets import BucketStream, watermarked
from quern.streaming.tail import TailReader, _whole, follow, parsed_stream, tail


def frame(spark, texts):
    return logs.parsed(logs.with_raw(logs.lines(spark, texts)))


def line(second, level="info"):
    return f"time=1970-01-01T00:00:{second:02d}Z level={level}"


def test_buckets_close_strictly_after_the_grace(spark, tmp_path):
    s = BucketStream(spark, Query(count=True, group_by=("level",), bucket="10s", window_secs=5), str(tmp_path))
    s.add(frame(spark, [line(1), line(2, "error"), line(3)]), 0)
    assert s.closed() == []
    s.add(frame(spark, [line(15)]), 1)  # end 10 and grace 5: 15 isn't later
    assert s.closed() == []
    s.add(frame(spark, [line(16)]), 2)
    got = s.closed()
    assert [x.split()[:2] for x in got] == [["count=2", "key.level=info"], ["count=1", "key.level=error"]]
    s.add(frame(spark, [line(4)]), 3)  # late: a second row for its bucket
    assert [x.split()[0] for x in s.closed()] == ["count=1"]
    assert [x.split()[0] for x in s.finish()] == ["count=2"]


def test_a_batch_run_again_replaces_itself(spark, tmp_path):
    s = BucketStream(spark, Query(count=True, bucket="10s"), str(tmp_path))
    for _ in range(2):
        s.add(frame(spark, [line(1), line(2)]), 0)
    assert [x.split()[0] for x in s.finish()] == ["count=2"]


def test_reader_waits_for_whole_lines(tmp_path):
    path = tmp_path / "a.log"
    path.write_bytes(b"a=1\nb=")
    r = TailReader({"path": str(path), "startingOffset": "earliest"})
    at = r.initialOffset()
    rows, end = r.read(at)
    assert [x[0] for x in rows] == ["a=1"] and end["pos"] == 4
    with path.open("ab") as f:
        f.write(b"2\nc=3\n")
    rows, last = r.read(end)
    assert [x[0] for x in rows] == ["b=2", "c=3"]
    assert [x[0] for x in r.readBetweenOffsets(end, last)] == ["b=2", "c=3"]
    assert len(_whole(str(path))) == 12


def test_reader_reopens_only_if_asked(tmp_path):
    path = tmp_path / "a.log"
    path.write_bytes(b"a=1\n")
    plain, reopening = (TailReader({"path": str(path), "reopen": x}) for x in ("false", "true"))
    at = plain.initialOffset()
    os.replace(path, tmp_path / "a.log.1")
    path.write_bytes(b"n=1\n")
    assert list(plain.read(at)[0]) == []
    rows, end = reopening.read(at)
    assert [x[0] for x in rows] == ["n=1"] and end["ino"] != at["ino"]
    path.write_bytes(b"")  # cut short
    path.write_bytes(b"m=1\n")
    assert [x[0] for x in reopening.read(end | {"pos": 100})[0]] == ["m=1"]


def test_reader_drains_the_old_file_before_the_new_one(tmp_path):
    path = tmp_path / "a.log"
    path.write_bytes(b"a=1\n")
    r = TailReader({"path": str(path), "reopen": "true", "startingOffset": "latest"})
    at = r.initialOffset()
    with path.open("ab") as f:
        f.write(b"a=2\na=3\na=")  # after the last read, before the rename
        f.flush()
        os.replace(path, tmp_path / "a.log.1")
        path.write_bytes(b"n=1\n")
        rows, at = r.read(at)
        assert [x[0] for x in rows] == ["a=2", "a=3"]
        assert list(r.read(at)[0]) == []  # a line that isn't finished
        f.write(b"4\n")
    rows, end = r.read(at)
    assert [x[0] for x in rows] == ["a=4"]
    assert [x[0] for x in r.readBetweenOffsets(at, end)] == ["a=4"]
    rows, new = r.read(end)
    assert [x[0] for x in rows] == ["n=1"] and new["ino"] != end["ino"]
    with pytest.warns(UserWarning):  # another reader can't find the old file
        assert list(pickle.loads(pickle.dumps(r)).readBetweenOffsets(at, end)) == []


def test_tail_as_a_stream(spark, tmp_path):
    path = tmp_path / "a.log"
    path.write_text("level=old\n")
    seen = []
    q = parsed_stream(tail(spark, str(path), start="latest")).writeStream.foreachBatch(lambda df, i: seen.extend(r.raw for r in df.select("raw").collect())).trigger(processingTime="100 milliseconds").start()
    try:
        deadline = time.time() + 60
        while not q.recentProgress and time.time() < deadline:
            time.sleep(0.1)
        with path.open("a") as f:
            f.write("level=new n=1\nlevel=new n=2\n")
        while len(seen) < 2 and time.time() < deadline:
            time.sleep(0.1)
    finally:
        q.stop()
    assert seen == ["level=new n=1", "level=new n=2"]


@pytest.mark.parametrize("start", [None, "1970-01-01"])
@pytest.mark.parametrize(
    "options, want",
    [
        ({"count": True}, {None: ["2"], "1970-01-01": ["3"]}),
        ({"list_keys": True}, {None: ["level", "n", "p", "time"], "1970-01-01": ["level", "n", "o", "time", "p"]}),
        ({"list_values": ("n",)}, {None: ["4", "7"], "1970-01-01": ["1", "4", "7"]}),
        ({"after": 2}, {None: "4 5 6 7 8", "1970-01-01": "1 2 3 4 5 6 7 8"}),
        ({"before": 2}, {None: "3 4 5 6 7", "1970-01-01": "1 2 3 4 5 6 7"}),
        ({"context": 1}, {None: "3 4 5 6 7 8", "1970-01-01": "1 2 3 4 5 6 7 8"}),
    ],
    ids=["count", "list-keys", "list-values-for", "A", "B", "C"],
)
def test_follow_goes_on_with_summaries_and_context(spark, tmp_path, options, want, start):
    def text(n):
        return f"time=1970-01-01T00:00:{n:02d}Z level={'error' if n in (1, 4, 7) else 'info'} n={n} {'o=1' if n < 3 else 'p=1'}\n"

    path = tmp_path / "a.log"
    path.write_text(text(1) + text(2))
    out, batches = [], [[3, 4], [5], [6, 7, 8]]

    def until():
        q = spark.streams.active[0]
        seen = sum(p.numInputRows > 0 for p in q.recentProgress)
        if seen < until.sent:
            return time.time() > until.deadline
        if until.sent == len(batches):
            return True
        with path.open("a") as f:
            f.write("".join(map(text, batches[until.sent])))
        until.sent += 1
        return False

    until.sent, until.deadline = 0, time.time() + 60
    follow(spark, [str(path)], Query(where=("level=error",), follow=True, time_from=start, **options), out.append, until)
    got, expected = out, want[start]
    if isinstance(expected, str):
        got, expected = [x.split(" n=")[1].split()[0] for x in out], expected.split()
    elif "list_keys" in options:
        expected = sorted(expected)
    assert got == expected


def test_watermarked_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("\n".join([line(1), line(2), line(12), line(40)]) + "\n")
    lines = spark.readStream.option("lineSep", "\n").text(str(tmp_path / "in"))
    rows = watermarked(parsed_stream(lines), ("level",), 10_000_000_000, 5_000_000_000)
    q = rows.writeStream.outputMode("append").format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.bucket_start_ns, r["count"]) for r in spark.sql("select * from closed").collect()}
    assert got == {(0, 2), (10_000_000_000, 1)}
    assert spark.sql("select * from closed").where(F.col("bucket_end_ns") - F.col("bucket_start_ns") != 10_000_000_000).isEmpty()


def test_standard_input_is_answered_while_it_comes(spark):
    """A bucket is printed as soon as a later line closes it, before the input ends."""
    import threading

    from quern.plans.query import Query
    from quern.streaming.tail import listen

    out, closed, seen = [], threading.Event(), []

    def emit(line):
        out.append(line)
        closed.set()

    def lines():
        yield from (f"time=2026-01-01T00:00:{s:02d}Z level=info" for s in range(5))
        yield "time=2026-01-01T00:01:00Z level=info"
        seen.append(closed.wait(60))
        yield "time=2026-01-01T00:01:01Z level=info"

    listen(spark, lines(), Query(count=True, bucket="10s", window_secs=1), emit)
    assert seen == [True] and [x.split()[0] for x in out] == ["count=5", "count=2"]
    out.clear()
    listen(spark, iter(["a=1\r", "b=2", "a=3"]), Query(where=("exists a",)), out.append)
    assert out == ["a=1\r", "a=3"]
    out.clear()
    listen(spark, iter([f"n={i}" for i in range(7)]), Query(where=("n>=3",), count=True), out.append, most=2)
    assert out == ["4"]


def test_batches_of_standard_input_grow_while_it_is_ahead(spark, monkeypatch):
    """As many Spark jobs as answers take time, not as lines come; a bucket still closes once."""
    from quern.streaming.tail import Live, listen

    sizes, add = [], Live.add
    monkeypatch.setattr(Live, "add", lambda self, df, batch_id: (sizes.append(batch_id), add(self, df, batch_id)))
    texts = [f"time=2026-01-01T00:{i // 600:02d}:{i // 10 % 60:02d}Z kind={i % 3}" for i in range(3_000)]
    out = []
    listen(spark, iter(texts), Query(where=("kind!=1",), count=True, bucket="1min"), out.append, most=10)
    assert len(sizes) <= 20
    assert [x.split()[:2] for x in out] == [["count=400", f"bucket.start=2026-01-01T00:{m:02d}:00Z"] for m in range(5)]


def test_standard_input_that_fails_is_no_end(spark):
    from quern.streaming.tail import listen

    def lines():
        yield "n=1"
        raise OSError("gone")

    with pytest.raises(OSError, match="gone"):
        listen(spark, lines(), Query(count=True), [].append)


def test_many_held_lines_keep_their_order(spark):
    texts = [f'n={i} m="ä\\n{"x" * (i % 7)}"\r' for i in range(25_000)] + ["", "x" * 5_000_000, "y"]
    df = logs.held(spark, texts)
    assert df.rdd.getNumPartitions() > 3
    assert [r["value"] for r in df.orderBy(*logs.ORDER).collect()] == texts
