"""logfmt text as Spark columns: parsing, decoding, encoding.

A line becomes an ordered list of (k, v) pairs, duplicates kept and values raw. Two views
of a raw value differ in what they do with escapes: ``strip_quotes`` (what predicates and
times see) leaves them, ``unescape`` (what groups, lists and outputs see) decodes them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pairs of a line that count; the rest is dropped and flagged.
MOST_PAIRS = 256
PAIRS = "array<struct<k: string, v: string>>"

# a stray ``=...``, or a key with an optional value: quoted up to its closing quote, or all to the next space
_TOKEN = r'(?s)=[^ ]*|([^= ]+)(?:=("[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?\z)|[^ ]*))?'
# the same again, for patterns that walk over whole pairs from the start of a line and never back
VALUE = r'(?:"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?\z)|[^ ]*+)'
_BETWEEN = r"(?: |=[^ ]*+)*+"


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is looked at."""
    return F.transform(F.array(value), use)[0]


def once(value: Column) -> Column:
    """A value to be selected, made once: through a generator, which filters behind it aren't moved past with another copy of it."""
    return F.explode(F.array(value))


def line_of(value: Column) -> Column:
    """The line without its run of line ends."""
    return F.when(value.endswith("\n") | value.endswith("\r"), F.regexp_replace(value, r"[\r\n]+\z", "")).otherwise(value)


def all_pairs(line: Column) -> Column:
    """Every pair of the line, without the limit."""
    keys = F.regexp_extract_all(line, F.lit(_TOKEN), F.lit(1))
    values = F.regexp_extract_all(line, F.lit(_TOKEN), F.lit(2))
    both = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("k"), v.alias("v")))
    return F.filter(both, lambda p: p["k"] != "")


def pairs(line: Column) -> Column:
    return F.slice(all_pairs(line), 1, MOST_PAIRS)


def overflow(line: Column) -> Column:
    return F.size(all_pairs(line)) > MOST_PAIRS


def first_value(pairs: Column, key: str) -> Column:
    """Raw value of the first pair with the key; null if there is none."""
    return F.get(F.filter(pairs, lambda p: p["k"] == F.lit(key)), F.lit(0))["v"]


def seek(wanted: str) -> str:
    """A pattern that finds the first pair, within the limit of pairs, at which ``wanted`` matches."""
    return rf"(?s)\A(?:{_BETWEEN}(?!{wanted})[^= ]++(?:={VALUE})?+){{0,{MOST_PAIRS - 1}}}+{_BETWEEN}(?:{wanted})"


def seek_twice(wanted: str) -> str:
    """A pattern that finds two such pairs; it may find the second beyond the limit of pairs."""
    pair = rf"[^= ]++(?:={VALUE})?+"
    return seek(wanted) + rf"(?:={VALUE})?+(?:{_BETWEEN}(?!{wanted}){pair})*+{_BETWEEN}(?:{wanted})"


def key_pattern(*keys: str) -> str | None:
    """What matches these keys where a pair begins; nothing if a line can't have such keys."""
    possible = [java_literal(k) for k in keys if k and not re.search("[= ]", k)]
    return rf"(?:{'|'.join(possible)})(?=[= ]|\z)" if possible else None


def java_literal(text: str) -> str:
    return re.sub(r"([^\w])", r"\\\1", text, flags=re.ASCII) if text.isascii() else r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def first_value_of_line(line: Column, key: str) -> Column:
    """``first_value`` straight from the line: one pattern that stops at the pair, no pairs built."""
    pattern = key_pattern(key)
    if pattern is None:
        return F.lit(None).cast("string")
    pair = F.regexp_extract(line, seek(pattern).removesuffix(f"(?:{pattern})") + f"({pattern}(?:={VALUE})?+)", 1)
    return bound(pair, lambda p: F.when(p != "", F.substring(p, len(key) + 2, 2**31 - 1)))


def strip_quotes(v: Column) -> Column:
    quoted = v.startswith('"') & v.endswith('"') & (F.length(v) >= 2)
    return F.when(quoted, F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)


def _decoded(body: Column) -> Column:
    """Escapes without their backslashes; one at the very end is dropped.

    Backslashes of a run pair up from its left. Between pairs each one stands before another character, so
    the replacements don't meet each other's results.
    """

    def between(piece: Column) -> Column:
        for code, plain in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\", "")):
            piece = F.replace(piece, F.lit(code), F.lit(plain))
        return piece

    pairs = F.array_join(F.transform(F.split(body, r"\\\\", -1), between), "\\")
    return F.when(F.contains(body, F.lit("\\\\")), pairs).when(F.contains(body, F.lit("\\")), between(body)).otherwise(body)


def unescape(v: Column) -> Column:
    """The value that a raw one stands for."""

    def plain(v: Column) -> Column:
        # the closing quote is one that no backslash escapes: an even run of backslashes before it
        closed = (F.length(v) >= 2) & v.endswith('"') & v.rlike(r'(?s)\A"[^"\\]*+(?:\\.[^"\\]*+)*+"\z')
        body = F.substring(v, F.lit(2), F.length(v) - F.when(closed, 2).otherwise(0))
        return F.when(v.startswith('"'), bound(body, _decoded)).otherwise(v)

    return bound(v, plain)


def escape(v: Column) -> Column:
    """The raw form of a value: quoted if it is empty or holds a space, ``=``, a quote, a backslash or a control character."""
    body = F.replace(v, F.lit("\\"), F.lit("\\\\"))
    for plain, code in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(plain), F.lit(code))
    needs = (v == "") | v.rlike(r'[ ="\\\x00-\x1f]')
    return F.when(needs, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(v)


def logfmt_line(**fields: Column) -> Column:
    """A line from typed columns; null fields are left out."""
    return F.concat_ws(" ", *(F.concat(F.lit(f"{k}="), escape(v.cast("string"))) for k, v in fields.items()))
