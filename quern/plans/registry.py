"""The registered queries over logs, each with the SQL that gives the same rows from the typed tables.

The engine sees generated text only; the SQL sees typed columns only, so the two share no
parsing. Results whose order matters carry it as ``pos``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rows as text
from ..functions.logfmt import first_value_of_line, logfmt_line, once
from ..functions.logfmt import unescape as decoded
from ..functions.terminal import bar, sparkline
from ..functions.times import format_ns
from ..operators import aggregates as agg
from ..operators import slicing as cut
from ..sources import logs, scratch
from ..streaming.buckets import BucketStream
from . import views
from .durations import format_duration
from .query import Query

Fn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Fn] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Fn) -> Fn:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _parsed(df: DataFrame) -> DataFrame:
    return logs.parsed(logs.with_raw(df))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(views.events(spark, d))


def _run(df: DataFrame, q: Query) -> DataFrame:
    """Matching lines of a parsed relation: the engine's own steps."""
    out = df.where(cut.matched(q, cut.window_of(q, df)))
    if (sample := cut.sampled(q)) is not None:
        out = out.where(sample)
    return cut.first_n(out, q.limit) if q.limit is not None else out


def _file(spark: SparkSession, lines: DataFrame) -> str:
    """A text file of the lines, for queries that read one as the command line does."""
    path = scratch.folder(spark, "lines")
    lines.select("value").write.text(path, lineSep="\n")
    return path


def _output(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """What the command line prints, of queries that print one thing."""
    from .planner import Engine

    (part,) = Engine(spark, paths).output(Query(**options))
    return part


def _ids(df: DataFrame) -> DataFrame:
    return df.select(F.col("row_id").alias("event_id"))


def _filter(spark: SparkSession, d: str, *where: str) -> DataFrame:
    return _ids(_run(_events(spark, d), Query(where=where)))


def _value(key: str) -> Column:
    return cut.value_of(key)


#: Level of an event and its severity in SQL.
_LEVEL = "CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn' WHEN 'signup' THEN 'notice' WHEN 'click' THEN 'info' WHEN 'view' THEN 'debug' END"
_NS = "epoch_ns({})"
_RFC = "CASE WHEN microsecond({0}) % 1000000 = 0 THEN strftime({0}, '%Y-%m-%dT%H:%M:%SZ') ELSE rtrim(strftime({0}, '%Y-%m-%dT%H:%M:%S.%f'), '0') || 'Z' END"


# ---------------------------------------------------------------- parsing


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def parse_roundtrip_docs(spark, d):
    df = _parsed(views.documents(spark, d))
    return df.select(F.col("row_id").alias("doc_id"), once(_value("text")).alias("text")).where("text is not null")


@query("SELECT page_id, url, html FROM pages WHERE html IS NOT NULL")
def parse_roundtrip_pages(spark, d):
    df = _parsed(views.pages(spark, d))
    return df.select(F.col("row_id").alias("page_id"), _value("url").alias("url"), once(_value("html")).alias("html")).where("html is not null")


@query("SELECT event_id, CAST(6 + CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS BIGINT) AS n_pairs, false AS overflow FROM events WHERE event_type IS NOT NULL")
def parse_pair_count(spark, d):
    return _events(spark, d).select(F.col("row_id").alias("event_id"), F.size("pairs").cast("bigint").alias("n_pairs"), "overflow")


@query("SELECT event_id, props FROM events")
def parse_props_quoted(spark, d):
    return _events(spark, d).select(F.col("row_id").alias("event_id"), _value("props").alias("props"))


# ---------------------------------------------------------------- filters


@query("SELECT event_id FROM events WHERE event_type = 'purchase'")
def filter_eq(spark, d):
    return _filter(spark, d, "kind=purchase")


@query("SELECT event_id FROM events WHERE event_type <> 'purchase'")
def filter_ne(spark, d):
    return _filter(spark, d, "kind!=purchase")


@query("SELECT event_id FROM events")
def filter_ne_absent(spark, d):
    return _filter(spark, d, "nothing!=x")


@query("SELECT event_id FROM events WHERE value >= 50 AND value < 120.5")
def filter_num_range(spark, d):
    return _filter(spark, d, "value>=50 and value<120.5")


@query("SELECT c_custkey AS id, c_acctbal AS balance FROM customer WHERE c_acctbal < -100")
def filter_num_negative(spark, d):
    df = _run(_parsed(views.customers(spark, d)), Query(where=("balance<-100",)))
    return df.select(F.col("row_id").alias("id"), _value("balance").cast("double").alias("balance"))


@query("SELECT event_id FROM events WHERE event_type >= '50'")
def filter_num_fallback_text(spark, d):
    return _filter(spark, d, "kind>=50")


@query("SELECT event_id FROM events WHERE event_type < 'm'")
def filter_text_order(spark, d):
    return _filter(spark, d, "kind<m")


@query("SELECT event_id FROM events WHERE event_type IN ('purchase', 'error')")
def filter_level_ge(spark, d):
    return _filter(spark, d, "level>=WARNING")


@query("SELECT p_partkey AS id FROM part WHERE regexp_matches(p_type, 'ECO|^[P-S]') AND NOT regexp_matches(p_name, '^[[:alpha:]]+ [a-m]') AND regexp_matches(p_brand, '[[:digit:]]$')")
def filter_regex(spark, d):
    df = _run(_parsed(views.parts(spark, d)), Query(where=("type=~'ECO|^[P-S]'", "not name=~'^[[:alpha:]]+ [a-m]'", "brand=~'[[:digit:]]$'")))
    return df.select(F.col("row_id").alias("id"))


@query("SELECT event_id FROM events WHERE event_type = 'purchase' AND user_id IS NOT NULL")
def filter_exists(spark, d):
    return _filter(spark, d, "exists bonus")


@query("SELECT event_id FROM events WHERE NOT (event_type = 'click' OR event_type = 'view') AND value > 10 OR event_type = 'view' AND user_id % 10 = 7")
def filter_bool_nested(spark, d):
    return _filter(spark, d, "not (kind=click or kind=view) && value>10 || kind=view AND user=~7$")


@query("SELECT event_id FROM events WHERE event_type <> 'view' AND value > 20 AND user_id >= 5")
def filter_multi_if(spark, d):
    return _filter(spark, d, "kind!=view", "value>20", "user>=5")


@query("SELECT event_id FROM events WHERE event_type = 'click' AND user_id % 2 = 0")
def filter_dup_any(spark, d):
    return _ids(_run(_parsed(views.tagged_events(spark, d)), Query(where=("tag=click and tag=even",))))


@query("SELECT event_id, event_type <> 'click' AS none_is FROM events")
def filter_dup_not(spark, d):
    df = _parsed(views.tagged_events(spark, d))
    some, none = Query(where=("tag!=click",)), Query(where=("not tag=click",))
    return df.where(cut.matched(some, (None, None))).select(F.col("row_id").alias("event_id"), cut.matched(none, (None, None)).alias("none_is"))


# ---------------------------------------------------------------- time


def _slice(spark, d, low, high):
    return _ids(_run(_events(spark, d), Query(time_from=low, time_to=high)))


@query("SELECT event_id FROM events WHERE ts BETWEEN (SELECT date_trunc('day', min(ts)) FROM events) AND TIMESTAMP '2024-01-10 12:00:00'")
def time_slice_abs(spark, d):
    return _slice(spark, d, "1999-01-01", "2024-01-10T14:00:00+02:00")


@query("SELECT event_id FROM events WHERE ts >= (SELECT min(ts) FROM events) + INTERVAL 26 HOUR AND ts <= (SELECT max(ts) FROM events) - INTERVAL 90 MINUTE")
def time_slice_symbolic(spark, d):
    df = _events(spark, d)
    df = df.withColumn("row_id", F.col("ts_ns"))  # lines in order of time, as in a log
    q = Query(time_from="start+1d+2h", time_to="end-1h-30min")
    df = df.withColumn("id", _value("user"))
    low, high = cut.window_of(q, df)
    return _ids(_events(spark, d).where(cut.matched(q, (low, high))))


@query("SELECT event_id FROM events WHERE ts >= (SELECT date_trunc('day', min(ts)) FROM events) + INTERVAL 18 HOUR AND ts <= (SELECT date_trunc('day', max(ts)) FROM events) + INTERVAL 30 MINUTE")
def time_slice_tod(spark, d):
    df = _events(spark, d)
    q = Query(time_from="18:00", time_to="00:30:00")
    bounds = cut.window_of(q, df.withColumn("row_id", F.col("ts_ns")))
    return _ids(df.where(cut.matched(q, bounds)))


@query(f"SELECT {_RFC.format('min(ts)')} AS first, {_RFC.format('max(ts)')} AS last, CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS BIGINT) * 1000 AS span_ns FROM events")
def time_range(spark, d):
    low, high = cut.span(_events(spark, d))
    row = spark.createDataFrame([(low, high)], "a long, b long")
    assert format_duration(high - low)
    return row.select(format_ns(F.col("a")).alias("first"), format_ns(F.col("b")).alias("last"), (F.col("b") - F.col("a")).alias("span_ns"))


# ---------------------------------------------------------------- counts


@query("SELECT count(*) AS count FROM events")
def count_all(spark, d):
    # nothing is parsed for a count without a filter
    return logs.with_raw(views.events(spark, d)).agg(F.count(F.lit(1)).alias("count"))


@query("SELECT count(*) AS count FROM events WHERE event_type = 'error'")
def count_filtered(spark, d):
    return _run(_events(spark, d), Query(where=("level=error",), count=True)).agg(F.count(F.lit(1)).alias("count"))


def _counted(df: DataFrame, q: Query, streaming: bool = False, window=(None, None)) -> DataFrame:
    """Counted rows with their place in the order, keys without their prefix."""
    grid = agg.grid_of(q, window)
    out = agg.position(agg.counted(_run(df, q), q.group_by, grid, q.fill), agg.ordering(q.group_by, grid, streaming))
    return out.select(*(F.col(f"`key.{k}`").alias(k) for k in q.group_by), *([F.col("bucket_start_ns"), F.col("bucket_end_ns")] if grid else []), "count", "time_start_ns", "time_end_ns", "pos")


_AGG = "count(*) AS count, min(epoch_ns(ts)) AS time_start_ns, max(epoch_ns(ts)) AS time_end_ns"


@query(f"SELECT *, row_number() OVER (ORDER BY count DESC, level) AS pos FROM (SELECT {_LEVEL} AS level, {_AGG} FROM events GROUP BY 1)")
def group_by_one(spark, d):
    return _counted(_events(spark, d), Query(count=True, group_by=("level",)))


@query(f"SELECT *, row_number() OVER (ORDER BY count DESC, kind, \"user\") AS pos FROM (SELECT event_type AS kind, CAST(user_id AS VARCHAR) AS \"user\", {_AGG} FROM events WHERE value >= 50 GROUP BY 1, 2)")
def group_by_two(spark, d):
    return _counted(_events(spark, d), Query(where=("value>=50",), count=True, group_by=("kind", "user")))


@query("SELECT toxic, quality, count, row_number() OVER (ORDER BY count DESC, toxic, quality) AS pos FROM (SELECT coalesce(CAST(toxic AS VARCHAR), '') AS toxic, coalesce(CAST(quality AS VARCHAR), '') AS quality, count(*) AS count FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2)")
def group_missing_key(spark, d):
    return _counted(_parsed(views.labelled(spark, d)), Query(count=True, group_by=("toxic", "quality"))).select("toxic", "quality", "count", "pos")


_DAY = "epoch_ns(date_trunc('day', ts))"


@query(f"SELECT *, row_number() OVER (ORDER BY count DESC, bucket_start_ns) AS pos FROM (SELECT {_DAY} AS bucket_start_ns, {_DAY} + 86400000000000 AS bucket_end_ns, {_AGG} FROM events GROUP BY {_DAY})")
def bucket_day(spark, d):
    return _counted(_events(spark, d), Query(count=True, bucket="1d"))


_HOURS = "(epoch_ns(ts) - epoch_ns(ts) % 21600000000000)"


@query(f"SELECT *, row_number() OVER (ORDER BY count DESC, kind, bucket_start_ns) AS pos FROM (SELECT event_type AS kind, {_HOURS} AS bucket_start_ns, {_HOURS} + 21600000000000 AS bucket_end_ns, {_AGG} FROM events GROUP BY 1, 2)")
def bucket_group(spark, d):
    return _counted(_events(spark, d), Query(count=True, group_by=("kind",), bucket="6h"))


@query(f"SELECT *, row_number() OVER (ORDER BY bucket_start_ns, count DESC, kind) AS pos FROM (SELECT event_type AS kind, {_HOURS} AS bucket_start_ns, {_HOURS} + 21600000000000 AS bucket_end_ns, {_AGG} FROM events GROUP BY 1, 2)")
def bucket_streaming_order(spark, d):
    return _counted(_events(spark, d), Query(count=True, group_by=("kind",), bucket="6 hours"), streaming=True)


_N_BUCKETS = f"""
WITH w AS (SELECT min(epoch_ns(ts)) AS a, (max(epoch_ns(ts)) - min(epoch_ns(ts))) // 10 AS width FROM events),
b AS (SELECT a + least((epoch_ns(ts) - a) // width, 9) * width AS bucket_start_ns, a + least((epoch_ns(ts) - a) // width, 9) * width + width AS bucket_end_ns, ts FROM events, w),
c AS (SELECT bucket_start_ns, bucket_end_ns, {_AGG} FROM b GROUP BY 1, 2)
SELECT *, row_number() OVER (ORDER BY count DESC, bucket_start_ns) AS pos FROM c
"""


@query(_N_BUCKETS)
def n_buckets(spark, d):
    df = _events(spark, d)
    return _counted(df, Query(count=True, n_buckets=10), window=cut.anchors(df.withColumn("row_id", F.col("ts_ns"))))


@query("SELECT * FROM (VALUES ('bonus'), ('kind'), ('level'), ('props'), ('time'), ('user'), ('value')) AS t(key)")
def list_keys(spark, d):
    return agg.distinct_keys(_events(spark, d))


@query("SELECT DISTINCT event_type AS value FROM events")
def list_values(spark, d):
    return agg.distinct_values(_events(spark, d), ("kind",)).select("value")


@query("SELECT DISTINCT 0 AS i, 'role' AS key, role AS value FROM conversations UNION ALL SELECT DISTINCT 1, 'turn', CAST(turn AS VARCHAR) FROM conversations UNION ALL SELECT DISTINCT 2, 'role', role FROM conversations")
def list_values_multi(spark, d):
    return agg.distinct_values(_parsed(views.conversations(spark, d)), ("role", "turn", "role"))


@query("SELECT count(*) AS lines, count(*) FILTER (event_type = 'error') AS matched, CAST(0 AS BIGINT) AS invalid_utf8, CAST(sum(6 + CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS pairs, CAST(0 AS BIGINT) AS overflow FROM events")
def run_stats(spark, d):
    df = views.events(spark, d).withColumn("raw", logs.line_of(F.col("value")))
    df, seen = agg.statistics(logs.parsed(df), cut.matched(Query(where=("level=error",)), (None, None)))
    df.select("row_id").write.format("noop").mode("overwrite").save()
    names = ("lines", "matched", "invalid_utf8", "pairs", "overflow")
    got = seen.get
    return spark.createDataFrame([tuple(got[n] for n in names)], ", ".join(f"{n} long" for n in names))


# ---------------------------------------------------------------- rows


@query("SELECT c_custkey AS id, 'id=' || c_custkey || ' segment=' || c_mktsegment || ' src=\"a b\"' AS line FROM customer WHERE c_nationkey < 5")
def rm_add(spark, d):
    df = _run(_parsed(views.customers(spark, d)), Query(where=("nation<5",)))
    pairs = cut.edited(F.col("pairs"), ("name", "balance", "nation", "gone"), (("src", "a b"), ("gone", "1")))
    return df.select(F.col("row_id").alias("id"), text.logfmt_row(pairs).alias("line"))


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS value FROM events WHERE event_type = 'purchase' AND user_id IS NOT NULL")
def raw_key(spark, d):
    return _events(spark, d).select(F.col("row_id").alias("event_id"), once(_value("bonus")).alias("value")).where("value is not null")


@query("SELECT event_id, row_number() OVER (ORDER BY CASE WHEN event_type = 'purchase' THEN CAST(user_id AS VARCHAR) ELSE '' END, event_id) AS pos FROM events WHERE value > 50")
def sort_by(spark, d):
    df = _run(_events(spark, d), Query(where=("value>50",)))
    order = [F.coalesce(_value("bonus"), F.lit("")).asc(), F.col("row_id").asc()]
    return agg.position(df, order).select(F.col("row_id").alias("event_id"), "pos")


@query("SELECT event_id FROM events WHERE event_type = 'click' ORDER BY event_id LIMIT 100")
def limit_first(spark, d):
    return _ids(_run(_events(spark, d), Query(where=("kind=click",), limit=100)))


@query("SELECT event_id, row_number() OVER (ORDER BY CAST(user_id AS VARCHAR), event_id) AS pos FROM (SELECT * FROM events WHERE event_type = 'click' ORDER BY event_id LIMIT 100)")
def sort_after_limit(spark, d):
    df = _run(_events(spark, d), Query(where=("kind=click",), limit=100))
    return agg.position(df, [F.coalesce(_value("user"), F.lit("")).asc(), F.col("row_id").asc()]).select(F.col("row_id").alias("event_id"), "pos")


@query(f"SELECT *, row_number() OVER (ORDER BY count DESC, level) AS pos FROM (SELECT {_LEVEL} AS level, {_AGG} FROM (SELECT * FROM events ORDER BY event_id LIMIT 250) GROUP BY 1)")
def limit_before_count(spark, d):
    return _counted(_events(spark, d), Query(count=True, group_by=("level",), limit=250))


@query("SELECT event_id FROM events WHERE false")
def sample_zero(spark, d):
    return _ids(_run(_events(spark, d), Query(sample_rate=0.0)))


@query("SELECT event_id FROM events")
def sample_one(spark, d):
    return _ids(_run(_events(spark, d), Query(sample_rate=1.0)))


@query("SELECT event_id FROM events WHERE event_type <> 'view'")
def sample_if_zero(spark, d):
    return _ids(_run(_events(spark, d), Query(sample_rate=0.0, sample_if="kind=view")))


_CONTEXT = """
WITH m AS (SELECT event_id, event_type = 'signup' AND value > 100 AS hit FROM events),
n AS (SELECT event_id, hit, coalesce(bool_or(hit) OVER (ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), false) OR coalesce(bool_or(hit) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING), false) AS near FROM m)
SELECT event_id, hit AS matched FROM n WHERE near
"""


@query(_CONTEXT)
def context_lines(spark, d):
    df = _events(spark, d)
    hit = cut.matched(Query(where=("kind=signup and value>100",)), (None, None))
    return cut.with_context(df, hit, before=1, after=2).select(F.col("row_id").alias("event_id"), "matched")


@query("SELECT event_id % 2 AS file_idx, event_type AS kind, count(*) AS count FROM events GROUP BY ALL")
def union_two_inputs(spark, d):
    both = views.events(spark, d, 0).unionByName(views.events(spark, d, 1))
    return _parsed(both).groupBy(F.col("file_idx").cast("bigint").alias("file_idx"), _value("kind").alias("kind")).agg(F.count(F.lit(1)).alias("count"))


@query("""SELECT c_custkey AS id, '{"id":"' || c_custkey || '","segment":' || to_json(c_mktsegment) || ',"note":"a \\"b\\""}' AS line FROM customer""")
def json_rows(spark, d):
    df = _parsed(views.customers(spark, d))
    pairs = cut.edited(F.col("pairs"), ("name", "balance", "nation"), (("note", 'a "b"'),))
    return df.select(F.col("row_id").alias("id"), text.json_row(pairs).alias("line"))


@query("SELECT o_orderkey AS id, 'status=' || o_orderstatus || ' priority=' || CASE WHEN contains(o_orderpriority, ' ') THEN '\"' || o_orderpriority || '\"' ELSE o_orderpriority END AS line FROM orders")
def logfmt_rows(spark, d):
    df = _parsed(views.orders(spark, d))
    return df.select(F.col("row_id").alias("id"), text.logfmt_row(cut.edited(F.col("pairs"), ("time", "id", "price"), ())).alias("line"))


@query(f"SELECT 'count=' || count(*) || ' key.level=' || level || ' bucket.start=' || strftime(day, '%Y-%m-%dT00:00:00Z') || ' bucket.end=' || strftime(day + INTERVAL 1 DAY, '%Y-%m-%dT00:00:00Z') || ' time.start=' || {_RFC.format('min(ts)')} || ' time.end=' || {_RFC.format('max(ts)')} AS line FROM (SELECT *, {_LEVEL} AS level, date_trunc('day', ts) AS day FROM events) GROUP BY level, day")
def agg_row_text(spark, d):
    df = agg.counted(_events(spark, d), ("level",), agg.Grid(86_400_000_000_000))
    return df.select(text.logfmt_count(("level",), True).alias("line"))


@query(f"""SELECT '{{"count":' || count(*) || ',"keys":{{"level":"' || level || '"}},"time.start":"' || {_RFC.format('min(ts)')} || '","time.end":"' || {_RFC.format('max(ts)')} || '"}}' AS line FROM (SELECT *, {_LEVEL} AS level FROM events) GROUP BY level""")
def agg_row_json(spark, d):
    return agg.counted(_events(spark, d), ("level",)).select(text.json_counted(("level",), False).alias("line"))


# ---------------------------------------------------------------- dashboard


def _hourly(spark, d) -> DataFrame:
    return agg.counted(_events(spark, d), ("kind", "user"), agg.Grid(3_600_000_000_000))


@query("SELECT event_type AS kind, CAST(user_id AS VARCHAR) AS \"user\", count(*) AS total, row_number() OVER (ORDER BY count(*) DESC, event_type, CAST(user_id AS VARCHAR)) AS pos FROM events GROUP BY event_type, user_id ORDER BY pos LIMIT 20")
def topk_totals(spark, d):
    top = agg.top_totals(_hourly(spark, d), ("kind", "user"), 20)
    return agg.position(top, [F.desc("total"), F.col("`key.kind`"), F.col("`key.user`")]).select(F.col("`key.kind`").alias("kind"), F.col("`key.user`").alias("user"), "total", "pos")


_HOUR = "(epoch_ns(ts) - epoch_ns(ts) % 3600000000000)"


@query(f"SELECT kind, string_agg(b || ':' || n, ',' ORDER BY b) AS points FROM (SELECT event_type AS kind, {_HOUR} AS b, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY kind")
def series(spark, d):
    rows = agg.series(agg.counted(_events(spark, d), ("kind",), agg.Grid(3_600_000_000_000)), ("kind",))
    return rows.select(F.col("`key.kind`").alias("kind"), F.array_join(F.transform("points", lambda p: F.concat(p["bucket_start_ns"].cast("string"), F.lit(":"), p["count"].cast("string"))), ",").alias("points"))


@query(f"SELECT CAST(count(*) AS BIGINT) AS total, count(DISTINCT (event_type, user_id)) AS combos, count(DISTINCT {_HOUR}) AS buckets, max(epoch_ns(ts)) - min(epoch_ns(ts)) AS span_ns FROM events")
def agg_stats(spark, d):
    return agg.totals(_hourly(spark, d), ("kind", "user")).select("total", "combos", "buckets", "span_ns")


@query(f"SELECT count(*) AS lines, count(DISTINCT {_LEVEL}) AS levels, max(epoch_ns(ts)) - min(epoch_ns(ts)) AS span_ns FROM events")
def raw_stats(spark, d):
    return agg.raw_totals(_events(spark, d)).select("lines", "levels", "span_ns")


# ---------------------------------------------------------------- streaming and scale


@query(f"SELECT event_type AS kind, {_HOURS} AS bucket_start_ns, {_HOURS} + 21600000000000 AS bucket_end_ns, {_AGG} FROM events GROUP BY 1, 2")
def stream_bucket_exact(spark, d):
    """The exact bucket stream fed in two batches in order of time; its closed rows and what is open at the end."""
    df = _events(spark, d)
    low, high = cut.span(df)
    stream = BucketStream(spark, Query(count=True, group_by=("kind",), bucket="6h"))
    half = (low + high) // 2
    stream.add(df.where(F.col("ts_ns") <= half), 0)
    closed = stream.closed_rows()
    stream.add(df.where(F.col("ts_ns") > half), 1)
    rows = stream.state if closed is None else stream.state.unionByName(closed)
    return rows.select(F.col("`key.kind`").alias("kind"), "bucket_start_ns", "bucket_end_ns", "count", "time_start_ns", "time_end_ns")


@query("SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS count, min(epoch_ns(l_shipdate)) AS time_start_ns, max(epoch_ns(l_shipdate)) AS time_end_ns, row_number() OVER (ORDER BY count(*) DESC, l_returnflag, l_linestatus) AS pos FROM lineitem WHERE l_quantity >= 25 GROUP BY l_returnflag, l_linestatus")
def lineitem_log_pricing(spark, d):
    return _counted(_parsed(views.lineitems(spark, d)), Query(where=("qty>=25",), count=True, group_by=("flag", "status")))


@query("SELECT o_orderpriority AS priority, o_orderstatus AS status, count(*) AS count FROM orders GROUP BY 1, 2")
def orders_log_priority(spark, d):
    raw = logs.with_raw(views.orders(spark, d))
    key = lambda k: decoded(first_value_of_line(F.col("raw"), k)).alias(k)
    return raw.select(key("priority"), key("status")).groupBy("priority", "status").agg(F.count(F.lit(1)).alias("count"))


# ---------------------------------------------------------------- text files in, printed lines out


@query("SELECT CAST(count(*) AS VARCHAR) AS line FROM events WHERE event_type = 'purchase'")
def output_count(spark, d):
    return _output(spark, [_file(spark, views.events(spark, d))], where=("kind=purchase",), count=True)


@query("SELECT unnest(['bonus', 'kind', 'level', 'props', 'time', 'user', 'value']) AS line")
def output_keys(spark, d):
    return _output(spark, [_file(spark, views.events(spark, d))], list_keys=True)


@query("SELECT '[' || string_agg('\"' || event_type || '\"', ',' ORDER BY event_type) || ']' AS line FROM (SELECT DISTINCT event_type FROM events)")
def output_values_json(spark, d):
    return _output(spark, [_file(spark, views.events(spark, d))], list_values=("kind",), json=True)


@query("SELECT 'id=' || c_custkey || '  segment=' || c_mktsegment || CASE WHEN c_custkey % 2 = 1 THEN chr(13) ELSE '' END AS line FROM customer")
def output_verbatim(spark, d):
    """Lines as they are, spaces and carriage returns too."""
    df = spark.read.parquet(f"{d}/customer.parquet")
    line = F.concat(F.lit("id="), F.col("c_custkey"), F.lit("  segment="), F.col("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 1, "\r").otherwise(""))
    return _output(spark, [_file(spark, df.select(line.alias("value")))])


@query("SELECT '{\"id\":\"' || n_nationkey || '\",\"name\":\"the ' || n_name || '\"}' AS line FROM nation WHERE n_nationkey >= 5")
def output_json(spark, d):
    df = spark.read.parquet(f"{d}/nation.parquet")
    lines = df.select(logfmt_line(id=F.col("n_nationkey"), name=F.concat(F.lit("the "), F.col("n_name"))).alias("value"))
    return _output(spark, [_file(spark, lines)], where=("id>=5",), json=True)


@query("SELECT 'id=' || c_custkey || ' segment=' || c_mktsegment || ' seen=1' AS line FROM customer WHERE c_nationkey <> 3")
def output_many_files(spark, d):
    """Nine files, one scan."""
    df = spark.read.parquet(f"{d}/customer.parquet")
    lines = df.select("c_custkey", logfmt_line(id=F.col("c_custkey"), nation=F.col("c_nationkey"), segment=F.col("c_mktsegment")).alias("value"))
    folders = [_file(spark, lines.where(F.col("c_custkey") % 9 == k).coalesce(1)) for k in range(9)]
    files = [f for x in folders for f in spark.read.text(x).inputFiles()]
    return _output(spark, files, where=("nation!=3",), remove=("nation",), add=(("seen", "1"),))


@query("SELECT 'count=' || count(*) AS head, strftime(time_bucket(INTERVAL 12 HOUR, ts), 'bucket.start=%Y-%m-%dT%H:%M:%SZ') AS bucket FROM events WHERE event_type <> 'view' GROUP BY time_bucket(INTERVAL 12 HOUR, ts)")
def stdin_buckets(spark, d):
    """Standard input, answered batch by batch while it comes in order of time."""
    from ..streaming.tail import listen

    found: list[str] = []
    lines = (r["value"] for r in views.events(spark, d).orderBy(F.col("value")).select("value").toLocalIterator())
    listen(spark, lines, Query(where=("kind!=view",), count=True, bucket="12h"), found.append, most=4_000)
    return spark.createDataFrame([tuple(x.split(" ")[:2]) for x in found], "head string, bucket string")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-12 06:00:00'")
def time_slice_table(spark, d):
    """A time slice of an ingested table, whose row groups are pruned."""
    from .planner import Engine

    df = spark.read.parquet(f"{d}/events.parquet").select(logfmt_line(time=views.stamp(F.col("ts")), id=F.col("event_id")).alias("value"))
    path = scratch.folder(spark, "table") + logs.TABLE
    logs.ingest(Engine(spark, [_file(spark, df)]).lines(), path)
    rows = Engine(spark, [path]).matched(Query(time_from="2024-01-10T00:00:00Z", time_to="2024-01-12T06:00:00Z"))
    return rows.select(cut.value_of("id").cast("bigint").alias("event_id"))


# ---------------------------------------------------------------- dashboard text


@query("SELECT event_type AS kind, count(*) AS count, min(epoch_ns(ts)) AS time_start_ns FROM events GROUP BY 1 UNION ALL SELECT NULL, NULL, NULL FROM region")
def classify_lines(spark, d):
    """Counted rows as they are printed, read back, among lines that are none."""
    counts = _output(spark, [_file(spark, views.events(spark, d))], count=True, group_by=("kind",)).select(F.col("line").alias("value"))
    others = spark.read.parquet(f"{d}/region.parquet").select(F.concat(F.lit("id="), F.col("r_regionkey"), F.lit(" count=1")).alias("value"))
    rows = agg.classified(_parsed(logs.lines(spark, counts.unionByName(others))))
    return rows.select(F.get("combo", F.lit(0))["value"].alias("kind"), "count", "time_start_ns")


_DAYS = "(SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n FROM events GROUP BY 1, 2)"


@query(f"SELECT event_type AS kind, string_agg(substr(' ▁▂▃▄▅▆▇█', CAST(round_even(n * 1.0::DOUBLE / top * 8, 0) AS INTEGER) + 1, 1), '' ORDER BY day) AS line FROM (SELECT *, max(n) OVER (PARTITION BY event_type) AS top FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS k FROM {_DAYS}) WHERE k <= 20) GROUP BY 1")
def sparklines(spark, d):
    rows = agg.series(agg.counted(_events(spark, d), ("kind",), agg.Grid(86_400_000_000_000)), ("kind",))
    return rows.select(F.col("`key.kind`").alias("kind"), sparkline(F.transform("points", lambda p: p["count"]), 20).alias("line"))


@query("SELECT kind, repeat('█', CAST(floor(x) AS INTEGER)) || CASE WHEN floor(x) < 30 THEN substr(' ▏▎▍▌▋▊▉█', CAST(round_even((x - floor(x)) * 8, 0) AS INTEGER) + 1, 1) ELSE '' END AS line FROM (SELECT event_type AS kind, count(*) * 1.0::DOUBLE / max(count(*)) OVER () * 30 AS x FROM events GROUP BY 1)")
def bars(spark, d):
    rows = agg.counted(_events(spark, d), ("kind",))
    top = rows.agg(F.max("count").alias("top"))  # one row
    return rows.join(F.broadcast(top)).select(F.col("`key.kind`").alias("kind"), bar(F.col("count"), F.col("top"), 30).alias("line"))
