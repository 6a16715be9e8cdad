"""Output rows as text: logfmt, coloured logfmt and JSON lines, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .logfmt import escape, strip_quotes, unescape
from .times import format_ns

#: Greatest whole number that a JSON reader keeps exactly.
MOST_JSON = 2**53 - 1
#: Terminal codes of keys, times, quotes and levels.
_RESET, _BOLD, _TIME, _QUOTE = "\x1b[0m", "\x1b[1m", "\x1b[34m", "\x1b[1;34m"
_LEVELS = {"critical": "\x1b[97;41m", "crit": "\x1b[97;41m", "error": "\x1b[31m", "fatal": "\x1b[31m", "warn": "\x1b[33m", "warning": "\x1b[33m", "info": "\x1b[34m", "debug": "\x1b[90m", "trace": "\x1b[90m"}


def json_text(v: Column) -> Column:
    """The text as a JSON string."""
    whole = F.to_json(F.struct(v.alias("v")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def json_count(n: Column) -> Column:
    """A number, as text beyond what a JSON reader keeps exactly."""
    return F.when(n <= MOST_JSON, n.cast("string")).otherwise(F.concat(F.lit('"'), n.cast("string"), F.lit('"')))


def logfmt_row(pairs: Column) -> Column:
    """``k=v`` with raw values, joined by one space."""
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["k"], F.lit("="), p["v"])), " ")


def color_row(pairs: Column) -> Column:
    """``logfmt_row`` for a terminal: bold keys, blue times, quotes set apart, and ``level`` bold in the colour of the
    first level, whose name counts in lower or upper case only."""
    names = F.create_map(*(F.lit(x) for name, paint in _LEVELS.items() for x in (name, paint, name.upper(), paint)))
    first = F.get(F.filter(pairs, lambda p: p["k"] == "level"), F.lit(0))["v"]
    level = F.coalesce(F.try_element_at(names, F.regexp_replace(first, r'^"+|"+\z', "")), F.lit(""))

    def one(p):
        paint = F.when(p["k"].isin("time", "ts"), F.lit(_TIME)).when(p["k"] == "level", F.concat(F.lit(_BOLD), level)).otherwise(F.lit(""))
        quoted = p["v"].startswith('"') & p["v"].endswith('"') & (F.length(p["v"]) >= 2)
        quote = F.when(quoted, F.lit(f'{_QUOTE}"{_RESET}')).otherwise(F.lit(""))
        after = F.when(paint == "", F.lit("")).otherwise(F.lit(_RESET))
        return F.concat(F.lit(_BOLD), p["k"], F.lit(f"{_RESET}="), quote, paint, strip_quotes(p["v"]), after, quote)

    return F.array_join(F.transform(pairs, one), " ")


def json_row(pairs: Column) -> Column:
    """An object with the pairs in order, doubles and all; every value is a string."""
    fields = F.transform(pairs, lambda p: F.concat(json_text(p["k"]), F.lit(":"), json_text(unescape(p["v"]))))
    return F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}"))


def _times(bucketed: bool, zone: str) -> list[tuple[str, Column]]:
    names = ([("bucket.start", "bucket_start_ns"), ("bucket.end", "bucket_end_ns")] if bucketed else []) + [("time.start", "time_start_ns"), ("time.end", "time_end_ns")]
    return [(name, format_ns(F.col(column), zone)) for name, column in names]


def logfmt_count(keys: tuple[str, ...], bucketed: bool, zone: str = "UTC") -> Column:
    """A counted row as logfmt; times that are null are left out."""
    parts = [F.concat(F.lit("count="), F.col("count").cast("string"))]
    parts += [F.concat(F.lit(f"key.{k}="), escape(F.col(f"`key.{k}`"))) for k in keys]
    parts += [F.concat(F.lit(f"{name}="), c) for name, c in _times(bucketed, zone)]
    return F.concat_ws(" ", *parts)


def json_counted(keys: tuple[str, ...], bucketed: bool, zone: str = "UTC") -> Column:
    """A counted row as JSON, the keys in an object of their own."""
    parts = [F.concat(F.lit('"count":'), json_count(F.col("count")))]
    if keys:
        inner = F.concat_ws(",", *(F.concat(json_text(F.lit(k)), F.lit(":"), json_text(F.col(f"`key.{k}`"))) for k in keys))
        parts.append(F.concat(F.lit('"keys":{'), inner, F.lit("}")))
    parts += [F.concat(F.lit(f'"{name}":'), json_text(c)) for name, c in _times(bucketed, zone)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def humanized(n: int) -> str:
    """Bytes with a unit, as ``1.5 MiB``."""
    size, unit = float(n), 0
    units = ("B", "KiB", "MiB", "GiB", "TiB")
    while size >= 1024 and unit < len(units) - 1:
        size, unit = size / 1024, unit + 1
    return f"{n} B" if not unit else f"{size:.1f} {units[unit]}"
