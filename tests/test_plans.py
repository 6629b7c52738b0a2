"""Plain-Python rules: ranges, parameters, requests, settings, names of files, globs, pointers."""

import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidelake.functions import globs
from tidelake.functions.instants import day_segment, day_start, iso_text, next_slot, parse_iso, segment_start
from tidelake.functions.pointer import escape, pointer, split_pointer, unescape
from tidelake.model import DAY_MS, HOUR_MS
from tidelake.plans import config, requests, timerange
from tidelake.plans.requests import Refused, Request, ValueSpec
from tidelake.sources import tree
from tidelake.sources.wire import FrameDecoder, frame


@pytest.mark.parametrize(
    ("given_", "found"),
    [
        (dict(start=1000, end=5000), (1000, 5000)),
        (dict(start=1000, duration=2), (1000, 3000)),
        (dict(end=9000, duration="PT4S"), (5000, 9000)),
        (dict(start=1000, now=7000), (1000, 7000)),
        (dict(duration=0, now=7000), (7000, 7000)),
        (dict(duration="P1DT1H", now=DAY_MS * 2), (DAY_MS - HOUR_MS, DAY_MS * 2)),
    ],
)
def test_ranges(given_, found):
    assert timerange.resolve(**given_) == found


@pytest.mark.parametrize("bad", [dict(), dict(end=5), dict(start=9, end=5), dict(start=1, duration="x")])
def test_bad_ranges(bad):
    with pytest.raises(ValueError):
        timerange.resolve(**bad)


@pytest.mark.parametrize(("text", "window"), [("3", 3), ("0", 5), ("-1", 5), ("2x", 5), ("2.7", 5), ("", 5), (None, 5)])
def test_sma_parameter(text, window):
    assert timerange.sma_window(text) == window


@pytest.mark.parametrize(("text", "alpha"), [("0.5", 0.5), ("1", 1.0), ("0", 0.2), ("1.5", 0.2), ("x", 0.2), (None, 0.2)])
def test_ema_parameter(text, alpha):
    assert timerange.ema_alpha(text) == alpha


@pytest.mark.parametrize(("given_", "seconds"), [(None, None), (0, None), (-3, None), (0.2, 1), (10.9, 10)])
def test_resolution(given_, seconds):
    assert timerange.resolution_seconds(given_) == seconds


@given(st.text(alphabet="a~/01#", max_size=8))
def test_pointer_round_trip(key):
    assert unescape(escape(key)) == key
    assert split_pointer(pointer("a.b", key)) == ("a.b", key)


def test_plain_path_is_no_pointer():
    assert split_pointer("a.b") is None
    assert pointer("notifications.mob", "a/b~c") == "notifications.mob#/a~1b~0c"


def test_instants():
    assert iso_text(parse_iso("2026-08-23T01:02:03.004Z")) == "2026-08-23T01:02:03.004Z"
    assert day_segment(-1) == "1969-12-31" and segment_start("date=1970-01-02") == DAY_MS
    assert segment_start("date=1970-1-2") is None and segment_start("latest") is None and day_start(-1) == -DAY_MS
    assert next_slot(299_999, 5) == 300_000 and next_slot(300_000, 5) == 600_000
    with pytest.raises(ValueError):
        next_slot(0, 7)


def test_requests():
    ok = Request("values", 0, 10, context="self", specs=(ValueSpec("a.b"),))
    assert requests.validate(ok) is ok
    for bad in (
        Request("drop", 0, 1), Request("range", 0, float("nan")), Request("values", 0, 1, context="self"), Request("snapshot"),
        Request("values", 0, 1, context="self", specs=(ValueSpec("a", "median"),)), Request("values", 0, 1, context="self", specs=(ValueSpec("a"),) * 201), Request("range", 0, 1, limit="x"),
    ):
        with pytest.raises(Refused):
            requests.validate(bad)
    assert [requests.clamp_limit(x) for x in (None, 0, 2.9, 10**9)] == [100_000, 1, 2, 100_000]


def test_refusals():
    with pytest.raises(Refused, match="^Unknown aggregate median: use average, min, max, first, last, mid, middle_index, sma or ema$"):
        requests.check_aggregate("median")
    with pytest.raises(Refused, match="^Aggregate average does not apply to position path navigation.position: use first, last or middle_index$"):
        requests.refuse_positions([ValueSpec("navigation.position", "average")], True)
    requests.refuse_positions([ValueSpec("navigation.position", "average")], False)
    with pytest.raises(Refused):
        requests.refuse_positions([ValueSpec("navigation.position", "ema")], False)
    requests.guard_buckets(2, 1, 500_000_000)
    with pytest.raises(Refused):
        requests.guard_buckets(2, 1, 500_001_000)


def test_settings():
    made = config.normalise({"roll_minutes": 7, "max_paths": "x", "default_rate_ms": 1500.9, "filter_mode": "other", "filter_paths": ["a", 3, " "], "rates_ms": {"a": 5, "b": "x"}, "record_others": True})
    assert (made.roll_minutes, made.max_paths, made.default_rate_ms, made.filter_mode, made.filter_paths, made.rates_ms, made.record_others) == (5, 2000, 1500, "exclude", ("a",), {"a": 5.0}, True)


def test_file_names():
    hour = 1_700_000_000_000 // HOUR_MS * HOUR_MS
    names = [f"{hour}.parquet", f"{hour + 1}.parquet", f"{hour + HOUR_MS}.parquet", f"{hour + HOUR_MS + 1}.parquet", f"hour-{hour}.parquet", "x.parquet.tmp", "0.parquet", "latest.txt"]
    assert tree.live(names) == sorted([f"{hour}.parquet", f"{hour + HOUR_MS + 1}.parquet", f"hour-{hour}.parquet"])
    assert tree.needs_hot(None, 5) and tree.needs_hot(4, 5) and not tree.needs_hot(5, 5)


@pytest.mark.parametrize(
    ("pattern", "path", "hit"),
    [
        ("a.*", "a.b.c", True), ("a.*", "a.", True), ("a.*", "b.a", False), ("*", ".hidden", False), ("*", "x", True), ("a?c", "abc", True), ("a?c", "a/c", False), ("{a,b}.x", "b.x", True), ("{a,b}.x", "c.x", False),
        ("!a.*", "b", True), ("!a.*", "a.b", False), ("[ab].x", "a.x", True), ("[!ab].x", "a.x", False), ("a.{1..3}", "a.2", True), ("a+b.*", "a+b.c", True), ("**", "a/b", True), ("a*/b", "ax/b", True), ("{a,{b,c}d}", "cd", True),
    ],
)
def test_globs(pattern, path, hit):
    assert bool(re.search(globs.regex(pattern), path)) is hit


def test_literals_never_match_prefixes():
    matcher = globs.Matcher(["a.b", "n.*"])
    assert matcher.matches("a.b") and not matcher.matches("a.b.c") and matcher.matches("n.x.y") and not globs.Matcher([]).matches("a")


def test_frames():
    whole = frame({"a": 1}) + frame([2])
    decoder = FrameDecoder()
    assert [m for i in range(len(whole)) for m in decoder.push(whole[i : i + 1])] == [{"a": 1}, [2]]
    with pytest.raises(ValueError):
        list(FrameDecoder().push(b"\xff\xff\xff\xff"))
