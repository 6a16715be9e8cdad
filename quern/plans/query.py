"""A query as an immutable value, and the rules on which options go together."""

from __future__ import annotations

import math
from dataclasses import dataclass

from .durations import parse_bound, parse_duration, parse_zone
from .filters import parse


class QueryError(ValueError):
    """Options that contradict each other or are out of range."""


@dataclass(frozen=True)
class Query:
    where: tuple[str, ...] = ()
    time_from: str | None = None
    time_to: str | None = None
    count: bool = False
    group_by: tuple[str, ...] = ()
    bucket: str | None = None
    n_buckets: int | None = None
    list_keys: bool = False
    list_values: tuple[str, ...] = ()
    time_range: bool = False
    raw_key: str | None = None
    sort_by: str | None = None
    limit: int | None = None
    after: int | None = None
    before: int | None = None
    context: int | None = None
    sample_rate: float | None = None
    sample_if: str | None = None
    seed: int | None = None
    add: tuple[tuple[str, str], ...] = ()
    remove: tuple[str, ...] = ()
    json: bool = False
    color: bool = False
    zone: str = "UTC"
    follow: bool = False
    reopen: bool = False
    window_secs: int = 10
    parallel: int = 1
    fill: bool = False

    def __post_init__(self) -> None:
        for expression in self.where:
            parse(expression)
        for bound in (self.time_from, self.time_to):
            if bound is not None:
                parse_bound(bound)
        parse_zone(self.zone)
        self._check()

    @property
    def follows(self) -> bool:
        return self.follow or self.reopen

    @property
    def aggregates(self) -> bool:
        return self.count or self.list_keys or bool(self.list_values)

    @property
    def prints_lines(self) -> bool:
        return not self.aggregates and self.raw_key is None and not self.time_range

    @property
    def passthrough(self) -> bool:
        """Whether lines come out as they went in."""
        return not (self.where or self.add or self.remove or self.json or self.color)

    @property
    def lines_after(self) -> int:
        return self.after if self.after is not None else self.context or 0

    @property
    def lines_before(self) -> int:
        return self.before if self.before is not None else self.context or 0

    def _check(self) -> None:
        def no(rule: bool, message: str) -> None:
            if rule:
                raise QueryError(message)

        grid = self.bucket is not None or self.n_buckets is not None
        no((bool(self.group_by) or grid) and not self.count, "group-by, bucket and n-buckets need count")
        no(self.bucket is not None and self.n_buckets is not None, "bucket and n-buckets exclude each other")
        no(self.json and self.raw_key is not None, "json and raw-key exclude each other")
        no(self.json and self.color, "json and color exclude each other")
        no(self.time_range and self.follows, "time-range can't follow")
        no(self.parallel > 1 and self.limit is not None, "parallel and limit exclude each other")
        no(self.parallel > 1 and bool(self.lines_after or self.lines_before), "parallel and context exclude each other")
        no(self.follows and self.n_buckets is not None, "n-buckets can't follow")
        no(self.follows and bool(self.group_by) and self.bucket is None, "group-by needs a bucket when it follows")
        no(self.sample_if is not None and self.sample_rate is None, "sample-if needs sample-rate")
        if self.sample_rate is not None:
            no(math.isnan(self.sample_rate) or not 0 <= self.sample_rate <= 1, "sample-rate is from 0 to 1")
        if self.sample_if is not None:
            parse(self.sample_if)
        if self.bucket is not None:
            parse_duration(self.bucket)
        if self.n_buckets is not None:
            no(self.n_buckets <= 0, "n-buckets is at least 1")
        no(self.limit is not None and self.limit < 0, "limit is not negative")
        used = [("group-by", self.group_by), ("sort-by", (self.sort_by,)), ("list-values", self.list_values), ("raw-key", (self.raw_key,))]
        for name, keys in used:
            for key in self.remove:
                no(key in keys, f"rm of {key!r} conflicts with {name}")
        no(bool(self.add) and self.raw_key is not None, "add and raw-key exclude each other")

    def check_inputs(self, files: list[str], strict: bool = False) -> None:
        """Rules on inputs: ``-`` is text that isn't a file. ``strict`` also rejects what archives can do here but not elsewhere."""
        stdin = files.count("-")
        if stdin > 1:
            raise QueryError("- may be given once")
        if stdin and (self.follows or self.time_range):
            raise QueryError("- can't follow or give a time range")
        if not files or files == ["-"]:
            if self.follows or self.time_from or self.time_to or self.time_range or self.n_buckets is not None:
                raise QueryError("without files there is no follow, from, to, time-range or n-buckets")
        archives = [f for f in files if f.endswith((".zst", ".zstd", ".seekztd"))]
        if archives and self.follows:
            raise QueryError("an archive can't be followed")
        if strict and archives and (self.time_from or self.time_to or self.time_range):
            raise QueryError("a streamed archive has no time slicing in strict mode")


def parse_edits(remove: list[str], add: list[str]) -> tuple[tuple[str, ...], tuple[tuple[str, str], ...]]:
    """``K[,K]`` texts to drop and ``K=V[,K=V]`` texts to append."""
    gone = tuple(k for text in remove for k in text.split(",") if k)
    pairs = []
    for text in add:
        for item in text.split(","):
            key, eq, value = item.partition("=")
            if not eq or not key or any(c in key for c in ' ="'):
                raise QueryError(f"add takes K=V: {item!r}")
            pairs.append((key, value))
    return gone, tuple(pairs)
