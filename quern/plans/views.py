"""Logs made from typed tables: each row as a logfmt line, in the order of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.logfmt import escape, once

#: Types whose texts never need quotes.
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def stamp(ts: Column) -> Column:
    """A time without a zone as RFC 3339 with microseconds."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))


def _lines(df: DataFrame, order: list[str], /, **fields: Column) -> DataFrame:
    """The parsed relation's columns before parsing; ``row_id`` numbers lines by ``order``."""
    row = F.col(order[0]) if len(order) == 1 else F.col(order[0]) * 100 + F.col(order[1])
    # texts are columns of their own first, as a line looks at each several times
    kinds = [kind for _, kind in df.select(*fields.values()).dtypes]
    texts = df.select(row.cast("bigint").alias("row_id"), *(v.cast("string").alias(f"field.{k}") for k, v in fields.items()))
    value = F.concat_ws(" ", *(F.concat(F.lit(f"{k}="), (F.col if kind in NUMBERS else lambda x: escape(F.col(x)))(f"`field.{k}`")) for k, kind in zip(fields, kinds, strict=True)))
    return texts.select(F.lit(0).alias("file_idx"), F.lit(0).cast("bigint").alias("block_start"), "row_id", once(value).alias("value"))


def events(spark: SparkSession, sf_dir: str, part: int | None = None) -> DataFrame:
    """``time level kind user value props``; with ``part`` 0 or 1, half of the events as a file of its own."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    level = F.create_map(*(F.lit(x) for kv in {"error": "error", "purchase": "warn", "signup": "notice", "click": "info", "view": "debug"}.items() for x in kv))
    kind = F.col("event_type")
    out = _lines(df, ["event_id"], time=stamp(F.col("ts")), level=F.try_element_at(level, kind), kind=kind, user=F.col("user_id"), value=F.col("value"), props=F.col("props"), bonus=F.when(kind == "purchase", F.col("user_id")))
    if part is None:
        return out
    return out.where(F.pmod("row_id", F.lit(2)) == part).withColumn("file_idx", F.lit(part))


def tagged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose lines have the key ``tag`` twice: the kind, and whether the user is even or odd."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    line = F.concat_ws(" ", F.concat(F.lit("id="), F.col("event_id").cast("string")), F.concat(F.lit("tag="), F.col("event_type")), F.concat(F.lit("tag="), F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd")))
    return df.select(F.lit(0).alias("file_idx"), F.lit(0).cast("bigint").alias("block_start"), F.col("event_id").alias("row_id"), once(line).alias("value"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return _lines(df, ["doc_id"], id=F.col("doc_id"), lang=F.col("lang"), text=F.col("text"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with ``quality`` and ``toxic`` where they have a label."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _lines(docs.join(labels, "doc_id", "left"), ["doc_id"], id=F.col("doc_id"), source=F.col("source"), quality=F.col("quality"), toxic=F.col("toxic"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id"], id=F.col("page_id"), url=F.col("url"), html=F.col("html"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark.read.parquet(f"{sf_dir}/conversations.parquet"), ["conv_id", "turn"], conv=F.col("conv_id"), turn=F.col("turn"), role=F.col("role"), text=F.col("text"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark.read.parquet(f"{sf_dir}/customer.parquet"), ["c_custkey"], id=F.col("c_custkey"), name=F.col("c_name"), nation=F.col("c_nationkey"), balance=F.col("c_acctbal"), segment=F.col("c_mktsegment"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark.read.parquet(f"{sf_dir}/part.parquet"), ["p_partkey"], id=F.col("p_partkey"), name=F.col("p_name"), brand=F.col("p_brand"), type=F.col("p_type"), size=F.col("p_size"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark.read.parquet(f"{sf_dir}/orders.parquet"), ["o_orderkey"], time=stamp(F.col("o_orderdate")), id=F.col("o_orderkey"), status=F.col("o_orderstatus"), priority=F.col("o_orderpriority"), price=F.col("o_totalprice"))


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(
        spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_orderkey", "l_linenumber"], time=stamp(F.col("l_shipdate")), order=F.col("l_orderkey"), flag=F.col("l_returnflag"), status=F.col("l_linestatus"), qty=F.col("l_quantity"), price=F.col("l_extendedprice")
    )
