"""Times as nanoseconds since 1970 in UTC: parsing and printing as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .logfmt import VALUE, bound, key_pattern, seek, strip_quotes

NS = 1_000_000_000
_FORM = r"^(\d{4}-\d\d-\d\d)[Tt ](\d\d):(\d\d):(\d\d)(?:\.(\d{1,9}))?(?:[Zz]|([+-])(\d\d)(?::?(\d\d))?)?\z"
_USUAL = r"\A\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d{1,6})?+Z\z"


def parse_ns(text: Column) -> Column:
    """RFC 3339 (no suffix: UTC; second 60 rolls over) as nanoseconds; null if it isn't one or doesn't fit.

    The usual form, in UTC with at most microseconds, is read as Spark's own timestamp; for all
    others the grammar is matched once, after which the places of all but fraction and zone are known.
    """
    return bound(text, lambda t: F.coalesce(_usual(t), _any_form(t)))


def _usual(t: Column) -> Column:
    return F.when(t.rlike(_USUAL), F.try_multiply(F.unix_micros(t.try_cast("timestamp")), F.lit(1000).cast("bigint")))


def _any_form(text: Column) -> Column:
    number = lambda c: c.try_cast("bigint")
    zero = F.lit(0).cast("bigint")

    def fields(t: Column) -> Column:
        day = F.unix_date(F.substring(t, 1, 10).try_cast("date")).cast("bigint")
        clock = [number(F.substring(t, i, 2)).alias(name) for i, name in ((12, "h"), (15, "m"), (18, "s"))]
        tail = F.substring(t, F.lit(20), F.length(t))
        frac = F.when(tail.startswith("."), number(F.rpad(F.regexp_extract(tail, r"^\.(\d+)", 1), 9, "0"))).otherwise(zero)
        zone = F.when(F.contains(tail, F.lit("+")) | F.contains(tail, F.lit("-")), F.regexp_extract(tail, "[+-].*", 0)).otherwise("")
        return F.when(t.rlike(_FORM), F.struct(day.alias("day"), *clock, frac.alias("frac"), zone.alias("zone")))

    def seconds(f: Column) -> Column:
        off_h = F.when(f["zone"] == "", zero).otherwise(number(F.substring(f["zone"], 2, 2)))
        off_m = F.when(F.length(f["zone"]) > 3, number(F.substring(f["zone"], -2, 2))).otherwise(zero)
        sign = F.when(f["zone"].startswith("-"), F.lit(-1)).otherwise(F.lit(1))
        secs = f["day"] * 86400 + f["h"] * 3600 + f["m"] * 60 + f["s"] - sign * (off_h * 3600 + off_m * 60)
        good = (f["h"] <= 23) & (f["m"] <= 59) & (f["s"] <= 60) & (off_h <= 23) & (off_m <= 59)
        return F.struct(F.when(good, secs).alias("secs"), f["frac"].alias("frac"))

    def nanoseconds(x: Column) -> Column:
        # a negative whole second may be just under the range that its fraction brings it back into
        whole = F.try_multiply(x["secs"], F.lit(NS).cast("bigint"))
        near = F.try_add(F.try_multiply(x["secs"] + 1, F.lit(NS).cast("bigint")), x["frac"] - NS)
        return F.coalesce(F.try_add(whole, x["frac"]), F.when(x["secs"] < 0, near))

    return bound(bound(bound(text, fields), seconds), nanoseconds)


def time_of(line: Column) -> Column:
    """Time of a line: of its first ``time`` or ``ts`` pair, which alone decides. No pairs are built."""
    raw = F.regexp_extract(line, seek(key_pattern("time", "ts")) + f"(?:=({VALUE}))?+", 1)
    return parse_ns(bound(raw, strip_quotes))


def format_ns(ns: Column, zone: str = "UTC") -> Column:
    """RFC 3339 in a zone (UTC, a region or ``+HH:MM``): a fraction only if there is one, without trailing zeros."""
    secs = F.call_function("div", ns - F.pmod(ns, F.lit(NS)), F.lit(NS))
    rest = F.pmod(ns, F.lit(NS))
    frac = F.when(rest == 0, "").otherwise(F.concat(F.lit("."), F.regexp_replace(F.lpad(rest.cast("string"), 9, "0"), "0+$", "")))
    local = _local(secs, zone)
    shift = F.call_function("div", _seconds(local) - secs, F.lit(60)) if zone != "UTC" else F.lit(0)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    offset = F.concat(F.when(shift < 0, "-").otherwise("+"), two(F.call_function("div", F.abs(shift), F.lit(60))), F.lit(":"), two(F.abs(shift) % 60))
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), frac, F.when(shift == 0, F.lit("Z")).otherwise(offset))


_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def _local(secs: Column, zone: str) -> Column:
    """Wall clock of the zone; the session's own zone plays no part."""
    utc = F.timestamp_add("SECOND", secs, F.expr(_EPOCH))
    return utc if zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def _seconds(clock: Column) -> Column:
    return F.timestamp_diff("SECOND", F.expr(_EPOCH), clock)


def floor_to(ns: Column, width: int) -> Column:
    """Start of the epoch-aligned bucket; floors also before 1970."""
    return ns - F.pmod(ns, F.lit(width))
