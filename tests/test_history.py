"""Literal cases of the history API on one table, and on tiers."""

import pytest
from pyspark.sql import functions as F

from tidelake.api import Engine, History, PathSpec, delta_dict, over_store, over_table, write_ndjson
from tidelake.functions.instants import iso_text, parse_iso
from tidelake.model import DAY_MS, HOT, RAW_SERIES_LIMIT, SAMPLE
from tidelake.operators import scan, smoothing, snapshot, timeline
from tidelake.plans.requests import Refused, Request
from tidelake.queries import QUERIES, START
from tidelake.sources import tree

T = parse_iso("2026-08-23T00:00:00Z")


def row(ts, path="a.b", value=1.0, source="n2k.0", context="self", kind=None):
    kind = kind or ("boolean" if isinstance(value, bool) else "string" if isinstance(value, str) else "position" if isinstance(value, tuple) else "number")
    num = float(value) if kind == "number" else None
    text = str(value).lower() if kind == "boolean" else value if kind in ("string", "identity") else None
    lat, lon = value if kind == "position" else (None, None)
    return (T + ts, context, path, source, kind, num, text, lat, lon)


def table(spark, *rows):
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], HOT)


def ask(spark, rows, *specs, resolution=10, end=60_000, **more):
    history = History(Engine(over_table(table(spark, *rows))))
    answer = history.get_values([PathSpec(s) if isinstance(s, str) else PathSpec(*s) for s in specs], T, T + end, resolution=resolution, **more)
    return [[parse_iso(line[0]) - T, *line[1:]] for line in answer["data"]], answer


def test_average_and_gap(spark):
    data, answer = ask(spark, [row(1000, value=10), row(3000, value=20), row(25_000, value=7)], "a.b")
    assert data == [[0, 15.0], [10_000, None], [20_000, 7.0]]
    assert answer["values"] == [{"path": "a.b", "method": "average"}] and answer["context"] == "vessels.self"


def test_first_last_mid_out_of_order(spark):
    data, _ = ask(spark, [row(5000, value=50), row(1000, value=10), row(9000, value=90)], ("a.b", "first"), ("a.b", "last"), ("a.b", "mid"), ("a.b", "min"), ("a.b", "max"))
    assert data == [[0, 10.0, 90.0, 50.0, 10.0, 90.0]]


def test_series_align_and_sources_split(spark):
    assert ask(spark, [row(1000, value=1), row(12_000, "c.d", 2)], "a.b", "c.d")[0] == [[0, 1.0, None], [10_000, None, 2.0]]
    rows = [row(1000, value=7, source=None), row(2000, value=1)]
    data, answer = ask(spark, rows, "a.b", source_policy="all")
    assert data == [[0, 1.0, 7.0]] and answer["values"] == [{"path": "a.b", "method": "average", "$source": "n2k.0"}, {"path": "a.b", "method": "average"}]
    assert ask(spark, rows, ("a.b", "average", None, "n2k.0"), ("a.b", "average", None, None))[0] == [[0, 1.0, 7.0]]


def test_text_booleans_positions(spark):
    assert ask(spark, [row(1000, "s.t", False), row(5000, "s.t", True)], ("s.t", "first"), ("s.t", "last"))[0] == [[0, False, True]]
    points = [row(1000, "navigation.position", (60.1, 24.1), "gps.1"), row(2000, "navigation.position", (61.9, 25.9), "gps.2")]
    assert ask(spark, points, ("navigation.position", "first"), ("navigation.position", "last"))[0] == [[0, {"latitude": 60.1, "longitude": 24.1}, {"latitude": 61.9, "longitude": 25.9}]]
    with pytest.raises(Refused, match="does not apply to position path navigation.position"):
        ask(spark, points, "navigation.position")
    with pytest.raises(Refused, match="does not apply to text path s.t"):
        ask(spark, [row(1000, "s.t", "x")], "s.t")


def test_mixed_paths_keep_numbers(spark):
    data, _ = ask(spark, [row(1000, value=1), row(3000, value=2), row(25_000, value="x")], "a.b")
    assert [line for line in data if line[1] is not None] == [[0, 1.5]]


def test_raw_ignores_the_aggregate(spark):
    rows = [row(k * 1000, value=k * 10) for k in range(4)]
    assert ask(spark, rows, ("a.b", "max"), resolution=None)[0] == [[k * 1000, k * 10.0] for k in range(4)]
    assert ask(spark, rows, ("a.b", "sma", "2"), resolution=None)[0] == [[0, 0.0], [1000, 5.0], [2000, 15.0], [3000, 25.0]]
    assert [x[1] for x in ask(spark, rows, ("a.b", "sma", "2x"), resolution=None)[0]] == [0, 5, 10, 15]
    assert ask(spark, rows[1:], ("a.b", "middle_index"))[0] == [[1000, None], [2000, 20.0], [3000, None]]


def test_smoothing_over_gaps(spark):
    rows = [row(1000, value=0), row(2000, value=10), row(12_000, value=20), row(31_000, value=40)]
    assert ask(spark, rows, ("a.b", "sma", "2"), ("a.b", "ema", "0.5"))[0] == [[0, 5.0, 5.0], [10_000, 12.5, 12.5], [20_000, None, 12.5], [30_000, 30.0, 26.25]]


def test_raw_stamps_beside_buckets(spark):
    rows = [row(k * 1000, "c.d", k) for k in (1, 2, 3)] + [row(12_000, value=1), row(35_000, value=2)]
    data, _ = ask(spark, rows, "a.b", ("c.d", "middle_index"))
    assert [line[0] for line in data] == [1000, 2000, 3000, 10_000, 20_000, 30_000] and data[4] == [20_000, None, None]


def attitude(ts, source="n2k.0", **fields):
    return [row(ts, f"n.a#/{k}", v, source) for k, v in fields.items()]


def test_objects(spark):
    rows = [*attitude(1000, roll=1, pitch=1, yaw=1), *attitude(5000, roll=5, pitch=5), *attitude(3000, roll=3, pitch=3, yaw=3)]
    assert ask(spark, rows, ("n.a", "last"))[0] == [[0, {"pitch": 5.0, "roll": 5.0}]]
    with pytest.raises(Refused, match="does not apply to object path n.a"):
        ask(spark, rows, "n.a")
    assert ask(spark, rows, "n.a", resolution=None)[0][0] == [1000, {"pitch": 1.0, "roll": 1.0, "yaw": 1.0}]
    nulls = [*attitude(1000, None, roll=1, pitch=1), *attitude(5000, None, roll=5, yaw=5)]
    assert ask(spark, nulls, ("n.a", "last"))[0] == [[0, {"roll": 5.0, "yaw": 5.0}]]
    assert ask(spark, [row(1000, value=7), row(2000, "a.b#/c", 8)], ("a.b", "last"))[0] == [[0, 7.0]]
    assert ask(spark, [row(0, "notifications.mob#/a~1b~0c", "x")], ("notifications.mob", "last"))[0] == [[0, {"a/b~c": "x"}]]
    engine = Engine(over_table(table(spark, *[r for k in range(4) for r in attitude(k * 1000, roll=k, pitch=k, yaw=k)])))
    from tidelake.plans.requests import ValueSpec

    assert len(engine.read(Request("values", T, T + 60_000, context="self", specs=(ValueSpec("n.a"),), limit=2))[0]) == 2


def test_nothing_in_range(spark):
    assert ask(spark, [row(1000)], "x.y")[0] == [] and ask(spark, [row(1000)], "x.y", source_policy="all")[0] == []


def test_catalogue_and_ranges(spark):
    rows = [row(k * 1000, p) for k, p in enumerate(["a.b", "e.f", "g.h#/x", "g.h#/y", "a.b", "a.b"])] + [row(0, context="other")]
    engine = Engine(over_table(table(spark, *rows)))
    history = History(engine)
    assert history.get_paths(T, T + 60_000, "vessels.self") == ["a.b", "e.f", "g.h"] and history.get_contexts(T, T + 9) == ["other", "vessels.self"]
    assert history.has_any_data(T, T + 1) and not history.has_any_data(T - 5, T)
    found, cut = engine.read(Request("range", T, T + 60_000, context="self", limit=4))
    assert cut and [r["ts"] - T for r in found] == [0, 1000, 2000, 3000]
    assert not engine.read(Request("range", T, T + 60_000, paths=("g.h",)))[0]


def test_snapshots(spark):
    rows = [row(0, "p", 1), row(2 * DAY_MS, "p", 2), *attitude(0, roll=1, pitch=1, yaw=1), *attitude(1000, "gps.1", roll=2, pitch=2), row(0, "name", "Ann", kind="identity")]
    samples = table(spark, *rows)
    history = History(Engine(over_table(samples)))
    found = history.get_history(T + DAY_MS)
    values = {v["path"]: (v["value"], u["timestamp"], u.get("$source")) for d in found for u in d["updates"] for v in u["values"]}
    assert values["p"][0] == 1.0 and values["n.a"] == ({"roll": 2.0, "pitch": 2.0, "yaw": 1.0}, iso_text(T + 1000), "gps.1") and values[""][0] == {"name": "Ann"}
    assert [(r["context"], r["name"]) for r in snapshot.names(samples, T + 5).collect()] == [("self", "Ann")]


def test_numbers_beat_text_in_a_delta(spark):
    (delta,) = snapshot.deltas(table(spark, row(0, "a#/k", "x"), row(0, "a#/k", 4), row(0, "b", True))).collect()
    assert delta_dict(delta)["updates"][0]["values"] == [{"path": "a", "value": {"k": 4.0}}, {"path": "b", "value": True}]


def sma_line(line, window):
    there = [[v for v in line[: k + 1] if v is not None][-window:] for k in range(len(line))]
    return [None if v is None else sum(w) / len(w) for v, w in zip(line, there, strict=True)]


def ema_line(line, alpha):
    out = []
    for v in line:
        before = out[-1] if out else None
        out.append(before if v is None else v if before is None else alpha * v + (1 - alpha) * before)
    return out


def test_one_value_a_stamp_within_each_series(spark):
    rows = [row(1000, value=1, source="a"), row(1000, value=3, source="b"), row(2000, value=5, source="a")]
    assert ask(spark, rows, ("a.b", "average", None, "a"), resolution=None)[0] == [[1000, 1.0], [2000, 5.0]]
    assert ask(spark, rows, "a.b", resolution=None)[0] == [[1000, 3.0], [2000, 5.0]]
    assert ask(spark, rows, "a.b", resolution=None, source_policy="all")[0] == [[1000, 1.0, 3.0], [2000, 5.0, None]]
    assert ask(spark, rows, "a.b", ("a.b", "middle_index"))[0] == [[0, 3.0, None], [1000, None, None], [2000, None, 5.0]]
    history = History(Engine(over_table(table(spark, *rows))))
    assert history.values_frame([PathSpec("a.b")], T, T + 60_000, resolution=10).first()["v0"] == 3.0
    mixed = [row(1000, value=1), row(1000, value="x"), row(2000, value="y")]
    assert ask(spark, mixed, "a.b", resolution=None)[0] == [[1000, 1.0]]


def test_frames_agree_with_plain_smoothing(spark):
    line = [1.0, None, 3.0, None, None, 8.0, 2.0, 5.0]
    series = spark.createDataFrame([(0, k, v) for k, v in enumerate(line)], "spec int, bucket long, v double")

    def got(frame):
        return [r["v"] for r in frame.orderBy("bucket").collect()]

    assert got(smoothing.sma(series, 3)) == pytest.approx(sma_line(line, 3)) and got(smoothing.sma_running(series, 3)) == pytest.approx(sma_line(line, 3))
    assert got(smoothing.ema(series, 0.3)) == pytest.approx(ema_line(line, 0.3))
    empty = series.limit(0)
    assert timeline.matrix(empty, 2, 10).count() == 0 and smoothing.middle_index(empty).count() == 0


def test_values_frame_matches_matrix(spark):
    rows = [row(1000, value=0), row(2000, value=10), row(12_000, value=20), row(31_000, value=40)]
    history = History(Engine(over_table(table(spark, *rows))))
    specs = [PathSpec("a.b", "sma", "2"), PathSpec("a.b", "ema", "0.5"), PathSpec("a.b")]
    wide = [[r["bucket"] - T, r["v0"], r["v1"], r["v2"]] for r in history.values_frame(specs, T, T + 60_000, resolution=10).collect()]
    assert wide == [[parse_iso(x[0]) - T, *x[1:]] for x in history.get_values(specs, T, T + 60_000, resolution=10)["data"]]


def test_predicates_reach_the_scan(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    table(spark, row(0), row(1, "g.h#/x")).write.parquet(str(tmp_path / "t"))
    plan = scan.select(spark.read.schema(SAMPLE).parquet(str(tmp_path / "t")), T, T + 5, "self", ["g.h"], fields=True).select("value_num")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts" in plan and "GreaterThanOrEqual(path,g.h#/)" in plan and "ReadSchema: struct<ts:bigint,context:string,path:string,value_num:double>" in plan


def test_ndjson(spark, tmp_path):
    with open(tmp_path / "x", "w") as out:
        assert write_ndjson(spark.range(3), out, batch=2) == 3
    assert (tmp_path / "x").read_text().splitlines() == ['{"id":0}', '{"id":1}', '{"id":2}', '{"rows": 3}']


def test_engine_over_missing_store(spark, tmp_path):
    from tidelake.sources.files import Store

    store = Store(spark, f"file://{tmp_path}/none")
    engine = Engine(over_store(spark, store), lambda at, context, paths: tree.snapshot_at(spark, store, at, context, paths))
    assert engine.read(Request("exists", 0, 10))[0][0]["count"] == 0 and engine.read(Request("snapshot", at=5))[0] == []
    assert F is not None


def test_raw_smoothing_reads_the_whole_series(spark, tmp_path):
    n = RAW_SERIES_LIMIT + 10
    events = spark.range(n).selectExpr("id as event_id", f"timestamp_millis({START} + id * 10) as ts", "10L as user_id", "'error' as event_type", "cast(id as double) as value", "'{\"k\": 1}' as props")
    events.write.parquet(str(tmp_path / "events.parquet"))
    for name in ("sma_raw", "sma_wide", "ema_raw"):
        assert QUERIES[name](spark, str(tmp_path)).count() == n, name
    middle = QUERIES["middle_index"](spark, str(tmp_path))
    assert middle.count() == n and middle.where("v is not null").first()["v"] == n // 2


def tied(spark, path, n=60, at_once=6):
    """Errors of the own entity, ``at_once`` of each time, stored in an order of their own; the values in order of time and arrival."""
    rows = [(k, START + k // at_once * 10, float(k * 37 % 101)) for k in range(n)]
    stored = spark.createDataFrame(sorted(rows, key=lambda r: r[0] * 17 % n), "event_id long, at long, value double")
    stored.selectExpr("event_id", "timestamp_millis(at) as ts", "10L as user_id", "'error' as event_type", "value", "'{\"k\": 1}' as props").coalesce(1).write.parquet(str(path / "events.parquet"))
    return [(at, v) for _, at, v in rows]


def answer_of(spark, name, path):
    return sorted((r["bucket"], r["v"]) for r in QUERIES[name](spark, str(path)).collect())


def test_ema_raw_orders_rows_of_one_time_by_arrival(spark, tmp_path):
    expected, e = [], None
    for at, v in tied(spark, tmp_path):
        e = v if e is None else 0.2 * v + 0.8 * e
        expected.append((at, round(e, 6)))
    assert answer_of(spark, "ema_raw", tmp_path) == sorted(expected)


def mean_of_last(line, window):
    values = [v for _, v in line]
    return sorted((at, round(sum(values[max(0, k + 1 - window) : k + 1]) / min(k + 1, window), 6)) for k, (at, _) in enumerate(line))


def test_sma_raw_and_middle_index_order_rows_of_one_time_by_arrival(spark, tmp_path):
    line = tied(spark, tmp_path)
    assert answer_of(spark, "sma_raw", tmp_path) == mean_of_last(line, 5)
    middle = QUERIES["middle_index"](spark, str(tmp_path)).where("v is not null").collect()
    assert [(r["bucket"], r["v"]) for r in middle] == [line[len(line) // 2]]


def test_api_values_frame_has_the_times_of_its_first_series(spark, tmp_path):
    days = RAW_SERIES_LIMIT // 100 + 5  # 100 orders a day, one of them urgent: the urgent ones go on after the limit of all
    orders = spark.range(days * 100).selectExpr(
        "id as o_orderkey", "'O' as o_orderstatus", "cast(id % 1000 as double) as o_totalprice", "timestamp_seconds(id div 100 * 86400) as o_orderdate", "if(id % 100 = 0, '1-URGENT', '5-LOW') as o_orderpriority"
    )
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    found = QUERIES["api_values_frame"](spark, str(tmp_path)).collect()
    assert [r["bucket"] for r in found] == [d * DAY_MS for d in range(days - 5)]
    assert [r["v1"] for r in found] == [float(d * 100 % 1000) for d in range(days - 5)] and all(r["v0"] is not None for r in found)


def test_sma_wide_counts_each_row_of_one_time_and_forgets_old_values(spark, tmp_path):
    line = tied(spark, tmp_path, 260)
    assert answer_of(spark, "sma_wide", tmp_path) == mean_of_last(line, 50)
    line = [1e17, *[float(k % 7) for k in range(40)], None, 3.0]
    series = spark.createDataFrame([(0, k, v) for k, v in enumerate(line)], "spec int, bucket long, v double")
    got = {r["bucket"]: r["v"] for r in smoothing.sma_running(series, 4).collect()}
    assert [got[k] for k in range(len(line))] == pytest.approx(sma_line(line, 4))
    assert [r["v"] for r in smoothing.sma_running(series, 1).orderBy("bucket").collect()] == line
