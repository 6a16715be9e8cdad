"""Durations, bounds, zones, filter texts and option rules: no Spark."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quern.plans.durations import NS, SpecError, format_duration, parse_bound, parse_chain, parse_duration, parse_rfc3339, parse_zone
from quern.plans.filters import And, FilterError, HasKey, Not, Or, Pred, java_regex, parse
from quern.plans.query import Query, QueryError, parse_edits


@pytest.mark.parametrize("text,secs", [("5m", 300), ("1h", 3600), ("2 days", 172800), ("30 seconds", 30), ("1 hour", 3600), ("7min", 420)])
def test_duration(text, secs):
    assert parse_duration(text) == secs * NS


@pytest.mark.parametrize("text", ["", "5", "m", "0s", "-5m", "5x", "5m3s", "99999999999999d", "1.5h"])
def test_bad_duration(text):
    with pytest.raises(SpecError):
        parse_duration(text)


@given(st.lists(st.tuples(st.sampled_from("+-"), st.integers(1, 500), st.sampled_from("smhd")), min_size=1, max_size=5))
def test_chain_is_the_sum_of_its_terms(terms):
    text = "".join(f"{s}{n}{u}" for s, n, u in terms)
    flipped = "".join(f"{'-' if s == '+' else '+'}{n}{u}" for s, n, u in terms)
    want = sum((1 if s == "+" else -1) * parse_duration(f"{n}{u}") for s, n, u in terms)
    assert parse_chain(text) == want == -parse_chain(flipped)


@pytest.mark.parametrize("text", ["++1h", "+1h-", "1h", "+0s", "+1y", "+1h 2m", ""])
def test_bad_chain(text):
    with pytest.raises(SpecError):
        parse_chain(text)


@pytest.mark.parametrize(
    "text,ns",
    [
        ("1970-01-01T00:00:00Z", 0),
        ("1970-01-01 00:00:01.5", 1_500_000_000),
        ("1970-01-01T02:00:00+02:00", 0),
        ("1969-12-31T23:59:59.999999999Z", -1),
        ("2024-02-29t00:00:00z", 1_709_164_800 * NS),
        ("1970-01-01T00:00:60Z", 60 * NS),
        ("2023-02-29T00:00:00Z", None),
        ("1970-01-01T24:00:00Z", None),
        ("1970-01-01T00:00:00+24", None),
        ("1970-01-01T00:00:00.Z", None),
        ("9999-01-01T00:00:00Z", None),
        ("1970-01-01T00:00:00.1234567890Z", None),
    ],
)
def test_rfc3339(text, ns):
    assert parse_rfc3339(text) == ns


def test_bounds():
    day = 86400 * NS
    start, end = 10 * day + 5, 12 * day + 7
    assert parse_bound("1970-01-03").resolve(None, None, False) == 2 * day
    assert parse_bound("start+1h").resolve(start, end, False) == start + 3600 * NS
    assert parse_bound("end - 30 seconds").resolve(start, end, False) == end - 30 * NS
    assert parse_bound("end").resolve(start, end, True) == end
    assert parse_bound("18:00").resolve(start, end, False) == 10 * day + 18 * 3600 * NS
    assert parse_bound("18:00:01.5").resolve(start, end, True) == 12 * day + (18 * 3600 + 1) * NS + NS // 2
    for bad in ("Start", "noon", "25:00", "18:60", "start+", "1970-13-01"):
        with pytest.raises(SpecError):
            parse_bound(bad)
    with pytest.raises(SpecError):
        parse_bound("start").resolve(None, None, False)


def test_zone_and_format():
    assert [parse_zone(z) for z in ("utc", "+02", "-0330", "+05:30", "Europe/Berlin", "+00")] == ["UTC", "+02:00", "-03:30", "+05:30", "Europe/Berlin", "UTC"]
    with pytest.raises(SpecError):
        parse_zone("Nowhere/City")
    assert [format_duration(s * NS) for s in (0, 59, 60, 3600, 86400 + 4, 93784)] == ["0s", "59s", "1m0s", "1h0m0s", "1d0h0m4s", "1d2h3m4s"]


def test_filter_precedence():
    a, b, c = (Pred(k, "=", "1") for k in "abc")
    assert parse("a=1 or b=1 and c=1") == Or(a, And(b, c))
    assert parse("(a=1 || b=1) AND not c=1") == And(Or(a, b), Not(c))
    assert parse("! exists a && b=1") == And(Not(HasKey("a")), b)
    assert parse("not not a=1") == Not(Not(a))


def test_filter_words():
    assert parse('a="x \\"y\\" \\d"') == Pred("a", "=", 'x "y" d')
    assert parse(r"a=~\d+") == Pred("a", "=~", r"\d+")
    assert parse('"and"=1') == Pred("and", "=", "1")
    assert parse("a='b c'") == Pred("a", "=", "b c")


@pytest.mark.parametrize("text", ["", "a", "a=", "=1", "a=1 b=2", "(a=1", "a=1)", "a='x", "a=1 and", "not", "a=~(", "a=b&&c=d", "a=~(?=x)", r"a=~(x)\1"])
def test_filter_errors(text):
    with pytest.raises(FilterError):
        parse(text)


def test_regex_dialect():
    assert java_regex("a.b$") == r"(?dU)a.b\z"
    assert java_regex(r"[$a]\$") == r"(?dU)[$a]\$"
    assert java_regex("(?P<n>x)") == "(?dU)(?<n>x)"


@pytest.mark.parametrize(
    "options",
    [
        {"group_by": ("a",)},
        {"bucket": "1m"},
        {"count": True, "bucket": "1m", "n_buckets": 3},
        {"json": True, "raw_key": "a"},
        {"json": True, "color": True},
        {"time_range": True, "follow": True},
        {"parallel": 2, "limit": 1},
        {"parallel": 2, "context": 1},
        {"count": True, "n_buckets": 3, "follow": True},
        {"count": True, "group_by": ("a",), "reopen": True},
        {"sample_if": "a=1"},
        {"sample_rate": 1.5},
        {"sample_rate": float("nan")},
        {"remove": ("a",), "sort_by": "a"},
        {"remove": ("a",), "raw_key": "a"},
        {"add": (("a", "1"),), "raw_key": "b"},
        {"count": True, "n_buckets": 0},
    ],
)
def test_options_that_exclude_each_other(options):
    with pytest.raises(QueryError):
        Query(**options)


def test_inputs():
    Query().check_inputs(["a.log", "-"])
    for q, files in ((Query(), ["-", "-"]), (Query(follow=True), ["a", "-"]), (Query(time_from="start"), ["-"]), (Query(follow=True), ["a.zst"])):
        with pytest.raises(QueryError):
            q.check_inputs(files)
    with pytest.raises(QueryError):
        Query(time_from="start").check_inputs(["a.zst"], strict=True)


def test_edits():
    assert parse_edits(["a,b", "c"], ["x=1,y=a b"]) == (("a", "b", "c"), (("x", "1"), ("y", "a b")))
    with pytest.raises(QueryError):
        parse_edits([], ["x"])
