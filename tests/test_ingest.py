"""Routing, flattening, filters, caps, throttling, names; streams; replay; statistics; decoding."""

import json
import os
import math

import pytest
from pyspark.sql import functions as F
from test_history import T, attitude, row, table

from tidelake.api import History, Engine, over_table
from tidelake.functions import decode, globs
from tidelake.operators import statistics
from tidelake.operators.values import values
from tidelake.plans.requests import ValueSpec
from tidelake.plans.config import Config
from tidelake.sources import tree
from tidelake.sources.files import Store
from tidelake.streaming import ingest, replay, stream

CONFIG = Config(record_others=True, default_rate_ms=0)


def bus(spark, *items):
    rows = [(i.get("path", "a.b"), i.get("raw", json.dumps(i.get("value"))), i.get("context", "me"), i.get("source"), i.get("meta"), i.get("ts", k), k) for k, i in enumerate(items)]
    return spark.createDataFrame(rows, ingest.BUS)


def recorded(spark, *items, config=CONFIG):
    out = ingest.record(bus(spark, *items), config, "me").orderBy("rowid", "path").collect()
    return [(r["rowid"], r["context"], r["path"], r["value_kind"], r["value_num"] if r["value_num"] is not None else r["value_str"] or (r["value_lat"], r["value_lon"])) for r in out]


def test_routing(spark):
    got = recorded(
        spark, {"value": 1.5}, {"value": "x"}, {"value": True}, {"value": None}, {"value": [1]}, {"value": 2, "meta": True}, {"path": "navigation.position", "value": {"latitude": 60.5, "longitude": 24}},
        {"path": "navigation.position", "value": {"latitude": "60", "longitude": 24}}, {"path": "navigation.position", "value": {"latitude": 1}}, {"raw": "1e999"}, {"raw": "{broken"}, {"path": "", "value": 3}, {"value": 4, "context": "other"},
        {"path": "n.a", "value": {"roll": 1, "a/b~c": "t", "on": False, "": 9, "deep": {"x": 1}, "list": [2], "none": None}}, {"path": "n.b", "value": {"deep": {}}}, {"path": "n.anchor.position", "value": {"latitude": 1, "longitude": 2}},
    )
    assert got == [
        (0, "self", "a.b", "number", 1.5), (1, "self", "a.b", "string", "x"), (2, "self", "a.b", "boolean", "true"), (6, "self", "navigation.position", "position", (60.5, 24.0)), (12, "other", "a.b", "number", 4.0),
        (13, "self", "n.a#/a~1b~0c", "string", "t"), (13, "self", "n.a#/on", "boolean", "false"), (13, "self", "n.a#/roll", "number", 1.0), (15, "self", "n.anchor.position#/latitude", "number", 1.0), (15, "self", "n.anchor.position#/longitude", "number", 2.0),
    ]


def test_gates_and_names(spark):
    named = [{"path": "", "value": {"name": n}, "context": c} for n, c in (("Ann", "me"), ("Ann", "me"), ("Bob", "me"), (" ", "me"), ("Eve", "x"))] + [{"path": "", "value": {"name": 5}}]
    assert [x[1:] for x in recorded(spark, *named)] == [("self", "name", "identity", "Ann"), ("self", "name", "identity", "Bob"), ("x", "name", "identity", "Eve")]
    assert [x[1] for x in recorded(spark, *named, {"value": 1, "context": "x"}, config=Config(default_rate_ms=0))] == ["self", "self"]
    assert [x[1] for x in recorded(spark, *named, {"value": 1}, config=Config(record_self=False, record_others=True, default_rate_ms=0))] == ["x"]


def test_caps_follow_the_filter(spark):
    items = [{"path": p, "value": 1, "context": c} for p, c in (("skip.a", "a"), ("p.1", "b"), ("p.2", "c"), ("p.1", "a"), ("p.3", "b"), ("p.2", "b"))]
    config = Config(record_others=True, default_rate_ms=0, filter_paths=("skip.*",), max_contexts=2, max_paths=2)
    assert [(x[1], x[2]) for x in recorded(spark, *items, config=config)] == [("b", "p.1"), ("c", "p.2"), ("b", "p.2")]
    only = Config(record_others=True, default_rate_ms=0, filter_mode="include", filter_paths=("p.2",))
    assert [x[2] for x in recorded(spark, *items, config=only)] == ["p.2", "p.2"]


def test_throttle_is_greedy(spark):
    times = [0, 1999, 2000, 3999, 3000, 100, 2099, 2100]
    config = Config(record_others=True, default_rate_ms=2000)
    assert [x[0] for x in recorded(spark, *[{"value": k, "ts": t} for k, t in enumerate(times)], config=config)] == [0, 2, 5, 7]
    both = [{"value": 1, "ts": 0}, {"value": 1, "ts": 1, "context": "x"}, {"value": 1, "ts": 2, "source": "s2"}]
    assert [x[0] for x in recorded(spark, *both, config=config)] == [0, 1]
    rates = Config(record_others=True, default_rate_ms=2000, rates_ms={"a.*": 10, "a.b": 5, "a.c": 0})
    assert [x[0] for x in recorded(spark, *[{"value": 1, "ts": 5 * k} for k in range(3)], config=rates)] == [0, 1, 2]
    paths = spark.createDataFrame([("a.b",), ("a.x",), ("z",)], "p string").select(globs.rate(F.col("p"), {"a.*": 10, "a.b": 5, "*.x": 1}, 7).alias("r"))
    assert [r["r"] for r in paths.collect()] == [5.0, 10.0, 7.0]


def test_recording_stream_is_exactly_once(spark, tmp_path):
    source, store = tmp_path / "in", Store(spark, f"file://{tmp_path}/data")
    source.mkdir()
    for n in range(2):
        lines = [{"path": "a.b", "value": json.dumps(k), "context": "me", "source": None, "is_meta": False, "recv_ts": T + n * 10 + k, "seq": k} for k in range(3)]
        (source / f"{n}.json").write_text("\n".join(map(json.dumps, lines)))
    for _ in range(2):
        query = stream.record_stream(stream.read_bus(spark, str(source), 1), store, CONFIG, "me", str(tmp_path / "cp"))
        query.awaitTermination()
        assert sorted(r["ts"] - T for r in tree.read_hot(spark, store).collect()) == [0, 1, 2, 10, 11, 12]


def test_recording_stream_remembers(spark, tmp_path):
    """Three micro-batches give the rows of one batch, with caps, a rate and names in force."""
    items = [
        ("p.1", 1, "a", 0), ("", {"name": "Ann"}, "a", 0), ("p.2", 1, "b", 10), ("p.1", 2, "a", 500),
        ("p.3", 1, "a", 600), ("p.1", 3, "c", 700), ("p.1", 4, "a", 1999), ("", {"name": "Ann"}, "a", 2000), ("", {"name": "Eve"}, "c", 2100),
        ("p.1", 5, "a", 2000), ("p.2", 2, "b", 2011), ("", {"name": "Bob"}, "a", 2300), ("p.2", 3, "a", 2400), ("p.1", 6, "a", 100),
    ]
    lines = [{"path": p, "value": json.dumps(v), "context": c, "source": None, "is_meta": False, "recv_ts": T + t, "seq": k} for k, (p, v, c, t) in enumerate(items)]
    config = Config(record_others=True, default_rate_ms=2000, max_contexts=2, max_paths=2)
    source, store = tmp_path / "in", Store(spark, f"file://{tmp_path}/data")
    source.mkdir()
    for n, (a, b) in enumerate(((0, 4), (4, 9), (9, 14))):
        (source / f"{n}.json").write_text("\n".join(map(json.dumps, lines[a:b])))
        os.utime(source / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))
    stream.record_stream(stream.read_bus(spark, str(source), 1), store, config, "me", str(tmp_path / "cp")).awaitTermination()
    shown = ["ts", "context", "path", "value_num", "value_str"]
    got = sorted(map(tuple, tree.read_hot(spark, store).select(*shown).collect()), key=str)
    once = spark.createDataFrame([tuple(x.values()) for x in lines], "path string, value string, context string, source string, is_meta boolean, recv_ts long, seq long")
    assert got == sorted(map(tuple, ingest.record(once, config, "me").select(*shown).collect()), key=str)
    assert len([r for r in got if r[2] == "p.1"]) == 3 and {r[1] for r in got} == {"a", "b"} and [r[4] for r in got if r[2] == "name"] == ["Ann", "Bob"]
    assert store.names("state") == ["batch=000000000001", "batch=000000000002"]


def test_rename_replaces_files_and_folders(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    for text in ("one", "two"):
        store.write_text(text, "x")
        assert store.read_text("x") == text and store.names() == ["x"]
    for n in (1, 2):
        spark.range(n).write.parquet(store.at(f"new{n}"))
        store.rename(f"new{n}", "table")
        assert spark.read.parquet(store.at("table")).count() == n
    assert store.names() == ["table", "x"]


def test_stateful_throttle(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for n, times in enumerate(([0, 1999, 2000], [3999, 4000, 100])):
        (source / f"{n}.json").write_text("\n".join(json.dumps({"path": "a", "context": "c", "recv_ts": t, "seq": 10 * n + k, "rate": 2000.0}) for k, t in enumerate(times)))
        os.utime(source / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))  # files come in the order of their times
    schema = "path string, context string, recv_ts long, seq long, rate double"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    query = stream.throttle_stream(rows, schema).writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["seq"] for r in spark.table("kept").collect()) == [0, 2, 11, 12]


def test_streaming_windows_match_batches(spark, tmp_path):
    samples = table(spark, row(1000, value=10), row(3000, value=20), row(25_000, value=7))
    samples.coalesce(1).write.parquet(str(tmp_path / "in"))
    streamed = stream.windowed_average(spark.readStream.schema(samples.schema).parquet(str(tmp_path / "in")), 10_000)
    streamed.writeStream.format("memory").queryName("averages").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    want = values(samples, [ValueSpec("a.b")], 10_000).select("bucket", "num").collect()
    assert sorted((r["bucket"], r["num"]) for r in spark.table("averages").collect()) == sorted(map(tuple, want))


def test_replay_pages_keep_deltas_whole(spark):
    rows = [r for k in range(10) for r in attitude(k, roll=k, pitch=k, yaw=k)] + [row(20, "name", "Ann", kind="identity")]
    samples = table(spark, *rows)
    part = replay.page(samples, T, T + 100, 7)
    assert part.more and part.resume == T + 2 and part.rows.count() == 6
    assert replay.page(samples.where(F.col("ts") == T), T, T + 100, 2).resume == T + 1
    naps = []
    got = list(History(Engine(over_table(samples))).stream_history(T, lambda: T + 200_000, end=T + 100, sleep=naps.append))
    plain = [u["values"] for d in got for u in d["updates"] if u["values"][0]["path"] == "n.a"]
    assert len(plain) == 10 and all(len(v[0]["value"]) == 3 for v in plain)
    seen = [d for d in replay.play(over_table(samples), T, lambda: T + 200_000, end=T + 100, limit=7, sleep=naps.append)]
    assert [d["ts"] - T for d in seen] == [*range(10), 20] and naps


def test_replay_names_come_first_and_failures_are_retried(spark):
    samples = table(spark, row(0, "name", "Ann", kind="identity"), row(5), row(9))
    calls = []

    def flaky(start, end):
        calls.append(start)
        if len(calls) == 1:
            raise OSError("busy")
        return over_table(samples)(start, end)

    naps = []
    got = list(replay.play(flaky, T + 1, lambda: T + 200_000, end=T + 10, sleep=naps.append))
    assert naps[0] == 1.0 and [(d["ts"] - T, d["name"]) for d in got] == [(5, "Ann"), (9, None)]


def test_statistics(spark):
    rows = spark.createDataFrame([("s", "cpu", float(t), c, v) for t, c, v in ((0, 0.0, 1.0), (2, 10.0, 2.0), (4, 40.0, 6.0))], "subject string, metric string, t double, c double, v double")
    rates = statistics.counter_rates(rows, "subject", "t", "c")
    assert [r["rate"] for r in rates.orderBy("t").collect()] == [None, 5.0, 15.0]
    (line,) = statistics.rate_metrics(rates, {"cpu": (100.0, "%")}).collect()
    assert (line["unit"], line["n"], line["mean"], line["sd"]) == ("%", 2, 1000.0, None)
    with pytest.raises(Exception, match="a counter fell"):
        statistics.counter_rates(rows.withColumn("c", -F.col("c")), "subject", "t", "c").collect()
    (d,) = statistics.dispersion(rows, ["subject"], "v").collect()
    assert d["sd"] == pytest.approx(math.sqrt(7.0)) and (d["low"], d["high"], d["n"]) == (1.0, 6.0, 3)
    pairs = spark.createDataFrame([(0.0, 0.0), (-1.0, 1.0), (10.0, 10.5), (10.0, 20.0), (0.1, 0.2)], "a double, b double")
    got = pairs.select(statistics.drift(F.col("a"), F.col("b")).alias("d"), statistics.steady(F.col("a"), F.col("b"), F.lit(1.0)).alias("s"), statistics.agrees(F.col("a"), F.col("b")).alias("g")).collect()
    assert got[0]["d"] == 0 and got[1]["d"] == math.inf and [r["s"] for r in got] == [True, False, True, False, True] and [r["g"] for r in got[2:4]] == [True, False]
    lines = ["8 0 sda 1 0 100 0 1 0 50 0", "8 1 sda1 1 0 9 0 1 0 9 0", "7 0 loop0 1 0 9 0 1 0 9 0", "259 0 nvme0n1 1 0 7 0 1 0 3 0", "junk"]
    assert {(r["device"], r["read"], r["written"]) for r in statistics.disks(spark.createDataFrame([(x,) for x in lines], "line string")).collect()} == {("sda", 100, 50), ("nvme0n1", 7, 3)}
    runs = spark.createDataFrame([("s", "m", "ms", "a", 1.0), ("s", "m", "ms", "b", 2.0)], "subject string, metric string, unit string, label string, value double")
    assert tuple(statistics.comparison(runs, ["a", "b"]).first()) == ("s", "m", "ms", 1.0, 2.0)
    with pytest.raises(Exception, match="two units of m"):
        statistics.comparison(runs.withColumn("unit", F.col("label")), ["a", "b"]).collect()
    cold = statistics.cold_warm(rows, "subject", "t", "v").first()
    assert (cold["cold"], cold["warm"]) == (1.0, 4.0)


def test_decoding_columns(spark):
    rows = [row(0, value=1.5), row(1, "s", "q\"uote"), row(2, "b", True), row(3, "navigation.position", (1.0, 2.0)), *attitude(4, roll=1)]
    answer = values(table(spark, *rows), [ValueSpec(p) for p in ("a.b", "s", "b", "navigation.position", "n.a")])
    shown = answer.select("spec", decode.by_shape(*[F.col(c) for c in ("num", "str", "kind", "lat", "lon", "obj")]).alias("v"))
    assert {r["spec"]: json.loads(r["v"]) for r in shown.collect()} == {0: 1.5, 1: 'q"uote', 2: True, 3: {"latitude": 1.0, "longitude": 2.0}, 4: {"roll": 1.0}}
    kinds = table(spark, *rows[:4]).select("path", decode.by_kind(*[F.col(c) for c in ("value_kind", "value_num", "value_str", "value_lat", "value_lon")]).alias("v"))
    assert {r["path"]: json.loads(r["v"]) for r in kinds.collect()} == {"a.b": 1.5, "s": 'q"uote', "b": True, "navigation.position": {"latitude": 1.0, "longitude": 2.0}}
