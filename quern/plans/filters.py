"""The filter language: text to a small tree, and the tree to one Spark column.

``k=v k!=v k<v k<=v k>v k>=v k=~re exists k``, joined by ``and or not`` (``&& || !``) and
parentheses; ``not`` binds tightest, ``or`` least. A predicate holds if any pair with its
key satisfies it; ``!=`` also holds if no pair has the key. All columns made here are true
or false, never null.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.logfmt import bound, first_value_of_line, java_literal, key_pattern, seek, seek_twice, strip_quotes


class FilterError(ValueError):
    """A text that isn't a filter expression."""


@dataclass(frozen=True)
class Pred:
    key: str
    op: str
    value: str


@dataclass(frozen=True)
class HasKey:
    key: str


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class And:
    left: object
    right: object


@dataclass(frozen=True)
class Or:
    left: object
    right: object


# ---------------------------------------------------------------- text to tree

_OPS = ("!=", "<=", ">=", "=~", "=", "<", ">")
_ENDS = set("()=!<>\"'")


@dataclass(frozen=True)
class _Token:
    kind: str  # word, quoted, op, (, ), and, or, not
    text: str


def _tokens(text: str) -> list[_Token]:
    out: list[_Token] = []
    at = 0
    while at < len(text):
        c = text[at]
        if c.isspace():
            at += 1
        elif c in "()":
            out.append(_Token(c, c))
            at += 1
        elif text[at : at + 2] in ("&&", "||"):
            out.append(_Token("and" if c == "&" else "or", text[at : at + 2]))
            at += 2
        elif op := next((o for o in _OPS if text.startswith(o, at)), None):
            out.append(_Token("op", op))
            at += len(op)
        elif c == "!":
            out.append(_Token("not", c))
            at += 1
        elif c in "\"'":
            word, at = _quoted(text, at)
            out.append(_Token("quoted", word))
        else:
            end = at
            while end < len(text) and not text[end].isspace() and text[end] not in _ENDS:
                end += 1
            word = text[at:end]
            out.append(_Token(word.lower() if word.lower() in ("and", "or", "not") else "word", word))
            at = end
    return out


def _quoted(text: str, at: int) -> tuple[str, int]:
    """The text between quotes; a backslash stands for what follows it, but for n, r and t."""
    quote, out, i = text[at], [], at + 1
    while i < len(text):
        if text[i] == "\\" and i + 1 < len(text):
            out.append({"n": "\n", "r": "\r", "t": "\t"}.get(text[i + 1], text[i + 1]))
            i += 2
        elif text[i] == quote:
            return "".join(out), i + 1
        else:
            out.append(text[i])
            i += 1
    raise FilterError(f"unterminated quote in {text!r}")


class _Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, _tokens(text), 0

    def peek(self) -> str | None:
        return self.tokens[self.at].kind if self.at < len(self.tokens) else None

    def take(self) -> _Token:
        if self.at >= len(self.tokens):
            raise FilterError(f"unexpected end of {self.text!r}")
        self.at += 1
        return self.tokens[self.at - 1]

    def either(self):
        tree = self.both()
        while self.peek() == "or":
            self.take()
            tree = Or(tree, self.both())
        return tree

    def both(self):
        tree = self.negated()
        while self.peek() == "and":
            self.take()
            tree = And(tree, self.negated())
        return tree

    def negated(self):
        if self.peek() == "not":
            self.take()
            return Not(self.negated())
        if self.peek() == "(":
            self.take()
            tree = self.either()
            if self.peek() != ")":
                raise FilterError(f"missing ) in {self.text!r}")
            self.take()
            return tree
        return self.leaf()

    def leaf(self):
        key = self.take()
        if key.kind not in ("word", "quoted"):
            raise FilterError(f"expected a key at {key.text!r} in {self.text!r}")
        if key.kind == "word" and key.text.lower() == "exists" and self.peek() in ("word", "quoted"):
            return HasKey(self.take().text)
        op = self.take()
        if op.kind != "op":
            raise FilterError(f"expected an operator after {key.text!r} in {self.text!r}")
        value = self.take()
        if value.kind not in ("word", "quoted", "and", "or", "not") or value.text in ("&&", "||", "!"):
            raise FilterError(f"expected a value after {op.text!r} in {self.text!r}")
        if op.text == "=~":
            java_regex(value.text)
        return Pred(key.text, op.text, value.text)


def parse(text: str):
    parser = _Parser(text)
    if not parser.tokens:
        raise FilterError("empty filter expression")
    tree = parser.either()
    if parser.peek() is not None:
        raise FilterError(f"unexpected {parser.tokens[parser.at].text!r} in {text!r}")
    return tree


# ---------------------------------------------------------------- tree to column

#: Severities of level names.
LEVELS = {
    "trace": 0, "debug": 1, "info": 2, "notice": 3, "warn": 4, "warning": 4, "error": 5, "err": 5,
    "critical": 6, "crit": 6, "fatal": 7, "alert": 7, "emerg": 7, "panic": 7,
}
_NUMBER = r"(?i)^[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf|infinity|nan)\z"
_PY_NUMBER = re.compile(r"[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf|infinity|nan)", re.IGNORECASE | re.ASCII)


def level_rank(v: Column) -> Column:
    """Severity of a level name, null for other texts."""
    names = F.create_map(*(F.lit(x) for pair in LEVELS.items() for x in pair))
    return F.try_element_at(names, F.lower(v))


def to_number(v: Column) -> Column:
    """The text as a double if it is written as one, else null."""
    return F.when(v.rlike(_NUMBER), v.try_cast("double"))


_COMPARE = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def _ordered(v: Column, op: str, value: str) -> Column:
    """Compares by severity or number if the right side is one and the left side is too, else as texts."""
    compare = _COMPARE[op]
    as_text = compare(v, F.lit(value))
    if value.lower() in LEVELS and value.isascii():
        rank = level_rank(v)
        return F.when(rank.isNotNull(), compare(rank, F.lit(LEVELS[value.lower()]))).otherwise(as_text)
    if _PY_NUMBER.fullmatch(value):
        right = float(value)
        equal = F.lit(op in ("<=", ">="))  # a NaN on either side counts as equal

        def compared(number: Column) -> Column:
            test = equal if math.isnan(right) else F.when(F.isnan(number), equal).otherwise(compare(number, F.lit(right)))
            return F.when(number.isNotNull(), test).otherwise(as_text)

        return bound(to_number(v), compared)
    return as_text


#: What the bracketed class names stand for.
_CLASSES = {
    "alnum": r"0-9A-Za-z", "alpha": r"A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t\x20", "cntrl": r"\x00-\x1F\x7F", "digit": r"0-9",
    "graph": r"\x21-\x7E", "lower": r"a-z", "print": r"\x20-\x7E", "punct": r"\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E", "space": r"\t\n\x0B\f\r\x20",
    "upper": r"A-Z", "word": r"0-9A-Za-z_", "xdigit": r"0-9A-Fa-f",
}
_FLAGS = re.compile(r"\(\?([a-zA-Z]*)(?:-([a-zA-Z]+))?([:)])")
_NAMED = re.compile(r"\[:(\^?)(\w+):\]")
_CODE = re.compile(r"\\[uUx]\{([0-9A-Fa-f]+)\}")
_PROPERTY = re.compile(r"\\([pP])\{(\^?)(\w{3,})\}")


def java_regex(pattern: str) -> str:
    """The pattern for Java's engine: Unicode classes, a dot that only LF stops, ``$`` as the very end unless lines are asked for."""
    out, i, depth = [], 0, 0
    lines = [False]  # of each open group, whether (?m) holds
    while i < len(pattern):
        c, rest = pattern[i], pattern[i:]
        if c == "\\":
            if i + 1 == len(pattern):
                raise FilterError(f"bad regex {pattern!r}: a backslash at its end")
            if not depth and pattern[i + 1] in "123456789k":
                raise FilterError(f"back-references are not supported: {pattern!r}")
            if found := _CODE.match(rest):
                out.append(rf"\x{{{found[1]}}}")
            elif found := _PROPERTY.match(rest):
                out.append(rf"\{'p' if (found[1] == 'p') == (not found[2]) else 'P'}{{Is{found[3]}}}")
            else:
                out.append(pattern[i : i + 2])
            i += found.end() if found else 2
            continue
        if depth:
            if found := _NAMED.match(rest):
                if found[2] not in _CLASSES:
                    raise FilterError(f"unknown class {found[0]} in {pattern!r}")
                out.append(f"[{found[1]}{_CLASSES[found[2]]}]")
                i += found.end()
                continue
            depth += (c == "[") - (c == "]")
        elif c == "[":
            depth = 1
        elif c == "(":
            if re.match(r"\(\?(?:=|!|>|<=|<!)", rest):
                raise FilterError(f"look-around is not supported: {pattern!r}")
            if rest.startswith("(?P<"):
                out.append("(?<")
                lines.append(lines[-1])
                i += 4
                continue
            found = _FLAGS.match(rest)
            if found and {*found[1], *(found[2] or "")} & {"U", "R"}:
                raise FilterError(f"flag {found[0]} is not supported: {pattern!r}")
            holds = lines[-1] if not found or "m" not in found[1] + (found[2] or "") else "m" in found[1]
            if found and found[3] == ")":
                lines[-1] = holds
                out.append(found[0])
                i += found.end()
                continue
            lines.append(holds)
        elif c == ")":
            if len(lines) == 1:
                raise FilterError(f"bad regex {pattern!r}: ) without (")
            lines.pop()
        elif c == "$" and not lines[-1]:
            c = r"\z"
        out.append(c)
        i += 1
        if c == "[" and depth:  # a bracket that comes first stands for itself
            first = re.match(r"\^?\]?", pattern[i:])[0]
            out.append(first.replace("]", r"\]"))
            i += len(first)
    if depth or len(lines) > 1:
        raise FilterError(f"bad regex {pattern!r}: a bracket that isn't closed")
    java = "(?dU)" + "".join(out)
    _compiled(java, pattern)
    return java


def _compiled(java: str, pattern: str) -> None:
    """Asks Java itself, if it runs here; else a bad pattern shows when the query runs."""
    from pyspark import SparkContext

    if (context := SparkContext._active_spark_context) is None:
        if re.match(r"[*+?]", pattern):
            raise FilterError(f"bad regex {pattern!r}: nothing to repeat")
        return
    from py4j.protocol import Py4JError
    from pyspark.errors import PySparkException

    try:
        context._jvm.java.util.regex.Pattern.compile(java)
    except (Py4JError, PySparkException) as e:
        raise FilterError(f"bad regex {pattern!r}: {e}") from e


def _leaf(tree: Pred, pairs: Column, raw: Column | None) -> Column:
    mine = lambda p: p["k"] == F.lit(tree.key)
    if raw is not None and (quick := _in_line(tree, raw, _leaf(tree, pairs, None))) is not None:
        return quick
    if tree.op == "=":
        return F.exists(pairs, lambda p: mine(p) & (strip_quotes(p["v"]) == F.lit(tree.value)))
    if tree.op == "!=":
        differs = F.exists(pairs, lambda p: mine(p) & (strip_quotes(p["v"]) != F.lit(tree.value)))
        return differs | ~F.exists(pairs, mine)
    if tree.op == "=~":
        return F.exists(pairs, lambda p: mine(p) & strip_quotes(p["v"]).rlike(java_regex(tree.value)))
    return F.exists(pairs, lambda p: mine(p) & _ordered(strip_quotes(p["v"]), tree.op, tree.value))


_SIMPLE = re.compile(r"[^ \"\\]+")


def _in_line(tree: Pred, raw: Column, exact: Column) -> Column | None:
    """A predicate told from the line; ``exact``, which needs the pairs, is asked where a line has the key twice.

    ``=`` and ``!=`` are one pattern, if the value is one without quotes, spaces and escapes;
    the others test the first value.
    """
    key = key_pattern(tree.key)
    if key is None:
        return F.lit(tree.op == "!=")
    if tree.op in ("=", "!="):
        if not _SIMPLE.fullmatch(tree.value):
            return None
        value = java_literal(tree.value)
        same = rf'=(?:{value}(?=[ ]|\z)|"{value}")'
        if tree.op == "=":
            return raw.rlike(seek(key + same))
        return raw.rlike(seek(f"{key}(?!{same})")) | ~raw.rlike(seek(key))

    def holds(first: Column) -> Column:
        return first.rlike(java_regex(tree.value)) if tree.op == "=~" else _ordered(first, tree.op, tree.value)

    test = bound(bound(first_value_of_line(raw, tree.key), strip_quotes), holds)
    # most lines don't even have the key's text twice
    twice = (F.length(raw) - F.length(F.replace(raw, F.lit(tree.key), F.lit(""))) > len(tree.key)) & raw.rlike(seek_twice(key))
    return F.coalesce(test, F.lit(False)) | (twice & exact)


def to_column(tree, pairs: Column, raw: Column | None = None) -> Column:
    """The column of a tree over pairs; with the line itself, what can be told from it needs no pairs."""
    if isinstance(tree, Pred):
        return _leaf(tree, pairs, raw)
    if isinstance(tree, HasKey):
        if raw is not None:
            key = key_pattern(tree.key)
            return F.lit(False) if key is None else raw.rlike(seek(key))
        return F.exists(pairs, lambda p: p["k"] == F.lit(tree.key))
    if isinstance(tree, Not):
        return ~to_column(tree.of, pairs, raw)
    left, right = to_column(tree.left, pairs, raw), to_column(tree.right, pairs, raw)
    return left & right if isinstance(tree, And) else left | right


def all_of(expressions: list[str], pairs: Column) -> Column | None:
    """Several expressions joined by and; null if there is none."""
    columns = [to_column(parse(x), pairs) for x in expressions]
    return reduce(lambda a, b: a & b, columns) if columns else None
