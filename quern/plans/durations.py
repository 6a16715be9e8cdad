"""Durations and time bounds, as text on the driver; all results are nanoseconds."""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

NS = 1_000_000_000
_MIN, _MAX = -(1 << 63), (1 << 63) - 1
#: The names of each unit.
UNITS = {
    **dict.fromkeys(("s", "sec", "secs", "second", "seconds"), 1),
    **dict.fromkeys(("m", "min", "mins", "minute", "minutes"), 60),
    **dict.fromkeys(("h", "hr", "hrs", "hour", "hours"), 3600),
    **dict.fromkeys(("d", "day", "days"), 86400),
}


class SpecError(ValueError):
    """A text that isn't a duration, a bound or a zone."""


_TERM = re.compile(r"\s*(\d+)\s*([A-Za-z]+)\s*", re.ASCII)


def _fits(ns: int, text: str) -> int:
    if not _MIN <= ns <= _MAX:
        raise SpecError(f"duration out of range: {text!r}")
    return ns


def _term(text: str, at: int) -> tuple[int, int]:
    m = _TERM.match(text, at)
    if not m:
        raise SpecError(f"expected a number and a unit in {text!r}")
    if m[2].lower() not in UNITS:
        raise SpecError(f"unknown unit {m[2]!r} in {text!r}")
    return int(m[1]) * UNITS[m[2].lower()] * NS, m.end()


def parse_duration(text: str) -> int:
    """One positive number with a unit, as ``5m`` or ``2 hours``."""
    ns, at = _term(text, 0)
    if at != len(text):
        raise SpecError(f"unexpected {text[at:]!r} in duration {text!r}")
    if ns <= 0:
        raise SpecError(f"duration must be positive: {text!r}")
    return _fits(ns, text)


def parse_chain(text: str) -> int:
    """Signed terms, each with its sign, as ``+1d-3h``."""
    total, at = 0, 0
    while at < len(text):
        m = re.compile(r"\s*([+-])").match(text, at)
        if not m:
            raise SpecError(f"expected + or - in {text!r}")
        ns, at = _term(text, m.end())
        if ns == 0:
            raise SpecError(f"zero duration in {text!r}")
        total = _fits(total + (ns if m[1] == "+" else -ns), text)
    if not text:
        raise SpecError("empty duration")
    return total


def format_duration(ns: int) -> str:
    """As ``1d2h3m4s``: from the largest unit that counts down to seconds."""
    secs = abs(ns) // NS
    out, shown = "", False
    for unit, size in (("d", 86400), ("h", 3600), ("m", 60)):
        n, secs = divmod(secs, size)
        if n or shown:
            out, shown = out + f"{n}{unit}", True
    return f"{out}{secs}s"


_RFC = re.compile(r"(\d{4})-(\d\d)-(\d\d)[Tt ](\d\d):(\d\d):(\d\d)(?:\.(\d{1,9}))?(?:[Zz]|([+-])(\d\d)(?::?(\d\d))?)?", re.ASCII)
_DATE = re.compile(r"(\d{4})-(\d\d)-(\d\d)", re.ASCII)
_CLOCK = re.compile(r"(\d\d):(\d\d)(?::(\d\d)(?:\.(\d{1,9}))?)?", re.ASCII)


def _day(y: str, m: str, d: str) -> int | None:
    year, month, day = int(y), int(m), int(d)
    if not 1 <= month <= 12 or not 1 <= day <= (calendar.monthrange(year, month)[1] if year else 28 + (month != 2) * 2 + (month == 2)):
        return None
    # days from 1970-01-01 in the proleptic calendar
    y0, era = (year - (month <= 2)), (year - (month <= 2)) // 400
    yoe = y0 - era * 400
    doy = (153 * ((month + 9) % 12) + 2) // 5 + day - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468


def parse_rfc3339(text: str) -> int | None:
    m = _RFC.fullmatch(text)
    if not m or (day := _day(*m.group(1, 2, 3))) is None:
        return None
    h, mi, s = map(int, m.group(4, 5, 6))
    oh, om = int(m[9] or 0), int(m[10] or 0)
    if h > 23 or mi > 59 or s > 60 or oh > 23 or om > 59:
        return None
    secs = day * 86400 + h * 3600 + mi * 60 + s - (-1 if m[8] == "-" else 1) * (oh * 3600 + om * 60)
    ns = secs * NS + int((m[7] or "").ljust(9, "0"))
    return ns if _MIN <= ns <= _MAX else None


@dataclass(frozen=True)
class Bound:
    """A bound whose anchor, if it has one, is not known yet: ``at`` alone, or an offset to start or end, or a time of day."""

    kind: str  # at, start, end, clock
    ns: int

    def resolve(self, start: int | None, end: int | None, upper: bool) -> int:
        """Nanoseconds, given the times of the first and the last line; a time of day is on the UTC day of
        the start, or of the end for an upper bound."""
        if self.kind == "at":
            return self.ns
        anchor = {"start": start, "end": end, "clock": end if upper else start}[self.kind]
        if anchor is None:
            raise SpecError("no parseable timestamps to anchor the bound to")
        if self.kind == "clock":
            anchor -= anchor % (86400 * NS)
        return _fits(anchor + self.ns, "bound")

    @property
    def anchored(self) -> bool:
        return self.kind != "at"


def parse_bound(text: str) -> Bound:
    """RFC 3339, a date, ``start`` or ``end`` with signed durations, or a time of day; tried in this order."""
    text = text.strip()
    if (ns := parse_rfc3339(text)) is not None:
        return Bound("at", ns)
    if (m := _DATE.fullmatch(text)) and (day := _day(*m.groups())) is not None:
        return Bound("at", _fits(day * 86400 * NS, text))
    for anchor in ("start", "end"):
        if text.startswith(anchor):
            rest = text[len(anchor) :].strip()
            return Bound(anchor, parse_chain(rest) if rest else 0)
    if m := _CLOCK.fullmatch(text):
        h, mi, s = int(m[1]), int(m[2]), int(m[3] or 0)
        if h <= 23 and mi <= 59 and s <= 59:
            return Bound("clock", (h * 3600 + mi * 60 + s) * NS + int((m[4] or "").ljust(9, "0")))
    raise SpecError(f"not a time: {text!r}")


def parse_zone(text: str) -> str:
    """``UTC``, ``+HH:MM`` or a region's name, as Spark takes them."""
    low = text.strip()
    if low.lower() in ("utc", "z"):
        return "UTC"
    if low.lower() == "local":
        import time

        off = -(time.altzone if time.daylight and time.localtime().tm_isdst else time.timezone)
        return "UTC" if not off else f"{'+' if off >= 0 else '-'}{abs(off) // 3600:02d}:{abs(off) % 3600 // 60:02d}"
    if m := re.fullmatch(r"([+-])(\d\d)(?::?(\d\d))?", low, re.ASCII):
        if int(m[2]) > 23 or int(m[3] or 0) > 59:
            raise SpecError(f"not a time zone: {text!r}")
        return "UTC" if not int(m[2]) and not int(m[3] or 0) else f"{m[1]}{m[2]}:{m[3] or '00'}"
    try:
        ZoneInfo(low)
    except (ZoneInfoNotFoundError, ValueError, OSError) as e:
        raise SpecError(f"not a time zone: {text!r}") from e
    return low
