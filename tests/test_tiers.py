"""Roll, fold, seam, compaction, retention, pending records, sinks and sources."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F
from test_history import T, row, table

from tidelake.api import maintenance_slot
from tidelake.model import COLUMNS, DAY_MS, HOT, HOUR_MS, SAMPLE
from tidelake.queries import QUERIES
from tidelake.sinks import compaction, retention, roll
from tidelake.sources import adapters, pending, tree
from tidelake.sources.files import Store
from tidelake.sources.sqlite import SqliteSource
from tidelake.sources.wire import parse_lines

HOUR = T + 11 * HOUR_MS


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/data")


def stamps(frame):
    return sorted(r["ts"] - T for r in frame.collect())


def test_append_is_idempotent(spark, store):
    rows = table(spark, row(0), row(1)).select(*COLUMNS)
    assert roll.append_batch(store, rows, 3) and not roll.append_batch(store, rows, 3)
    assert tree.read_hot(spark, store).count() == 2
    roll.delete_through(spark, store, 2**62)
    assert not roll.append_batch(store, rows, 3) and tree.read_hot(spark, store).count() == 0


def test_invalid_rows_are_not_stored(spark, store):
    rows = spark.createDataFrame([(T, "self", "p", None, "number", float("nan"), None, None, None), (T, "self", "p", None, "other", 1.0, None, None, None), (T, "self", "p", None, "number", 1.0, None, None, None)], SAMPLE)
    roll.append_batch(store, rows, 0)
    assert tree.read_hot(spark, store).count() == 1


def test_roll_splits_days_and_folds(spark, store):
    roll.append_batch(store, table(spark, row(0), row(1000, value=2), row(DAY_MS, "c.d", 3)), 0)
    done = roll.roll(spark, store, T + DAY_MS, 2**60)
    assert done.rows == 3 and done.files == {"2026-08-23": 2, "2026-08-24": 1}
    assert stamps(tree.read_tree(spark, store)) == [0, 1000, DAY_MS]
    assert {(r["path"], r["value_num"]) for r in tree.read_latest(spark, store).collect()} == {("a.b", 2.0), ("c.d", 3.0)}
    with pytest.raises(roll.NameTaken):
        roll.roll(spark, store, T + DAY_MS, 2**60)


def test_unreadable_latest_is_rebuilt(spark, store):
    roll.append_batch(store, table(spark, row(0), row(5, "c.d")), 0)
    roll.roll(spark, store, T + 300_000, 2**60)
    store.write_text("junk", *tree.LATEST.split("/"))
    roll.fold_latest(spark, store, table(spark, row(9)))
    assert {(r["path"], r["ts"] - T) for r in tree.read_latest(spark, store).collect()} == {("a.b", 9), ("c.d", 5)}


def test_seam_counts_rows_once(spark, store):
    roll.append_batch(store, table(spark, *[row(k) for k in range(5)]), 0)
    roll.roll(spark, store, T + 300_000, 4)
    pending.write(store, pending.PendingRoll(T + 300_000, 4, "written"))
    roll.append_batch(store, table(spark, row(7), row(8)).withColumn("rowid", F.col("rowid") + 5), 1)
    assert stamps(tree.rows_between(spark, store, T, T + 100)) == [0, 1, 2, 3, 4, 7, 8]


def test_half_rolled_days_stay_whole(spark, store):
    roll.append_batch(store, table(spark, row(0), row(DAY_MS)), 0)
    roll.roll(spark, store, T + 300_000, 9)
    pending.write(store, pending.PendingRoll(T + 300_000, 9, "rolling"))
    store.delete("tree", "date=2026-08-24")
    assert stamps(tree.rows_between(spark, store, T, T + 2 * DAY_MS)) == [0, DAY_MS]
    assert roll.roll_once(spark, store, T + 600_000).rows == 2
    assert pending.read(store) is None and stamps(tree.rows_between(spark, store, T, T + 2 * DAY_MS)) == [0, DAY_MS]


@pytest.mark.parametrize("text", ["", "{", "[]", '{"rollId":0,"maxRowid":1,"phase":"rolling"}', '{"rollId":1,"maxRowid":1,"phase":"x"}', '{"rollId":true,"maxRowid":1,"phase":"written"}'])
def test_torn_records_count_as_none(store, text):
    store.write_text(text, *pending.PLACE)
    assert pending.read(store) is None


def rolls(spark, store, n=12, each=20):
    for k in range(n):
        rows = [row(11 * HOUR_MS + k * 300_000 + i * 1000, ("c.d", "a.b")[i % 2], i) for i in range(each)]
        roll.append_batch(store, table(spark, *rows).withColumn("rowid", F.col("rowid") + k * 1000), k)
        roll.roll(spark, store, HOUR + (k + 1) * 300_000, 2**60)
        roll.delete_through(spark, store, 2**60)


def test_compaction_changes_no_answer(spark, store):
    rolls(spark, store, 3)
    before = stamps(tree.rows_between(spark, store, T, T + DAY_MS))
    with pytest.raises(compaction.NotNow):
        compaction.compact_hour(spark, store, HOUR, HOUR + 1)
    with pytest.raises(compaction.NotNow):
        compaction.compact_hour(spark, store, HOUR + 1, HOUR + 9 * HOUR_MS)
    assert compaction.compact_hour(spark, store, HOUR, HOUR + HOUR_MS) == {"date=2026-08-23": "merged"}
    assert store.names("tree", "date=2026-08-23") == [f"hour-{HOUR}.parquet"]
    merged = [(r["path"], r["ts"]) for r in tree.read_tree(spark, store).collect()]
    assert merged == sorted(merged) and stamps(tree.rows_between(spark, store, T, T + DAY_MS)) == before
    assert compaction.compact_hour(spark, store, HOUR, HOUR + HOUR_MS) == {}
    with pytest.raises(roll.NameTaken):
        roll.append_batch(store, table(spark, row(11 * HOUR_MS)), 99)
        roll.roll(spark, store, HOUR + 5, 2**60)


def test_leftovers_of_a_merge(spark, store):
    rolls(spark, store, 2)
    day = "date=2026-08-23"
    inputs = store.names("tree", day)
    kept = tree.read_files(spark, [store.at("tree", day, n) for n in inputs]).collect()
    compaction.compact_hour(spark, store, HOUR, HOUR + HOUR_MS)
    roll.write_single(spark, store, spark.createDataFrame(kept[:3], SAMPLE), f"tree/{day}/{inputs[0]}", "_x")
    assert compaction.compact_hour(spark, store, HOUR, HOUR + HOUR_MS) == {day: "removed"}
    extra = spark.createDataFrame([*kept[:1], row(11 * HOUR_MS + 7, "new")], SAMPLE)
    roll.write_single(spark, store, extra, f"tree/{day}/{inputs[0]}", "_x")
    assert compaction.compact_hour(spark, store, HOUR, HOUR + HOUR_MS) == {day: "orphaned"}
    store.write_text("junk", "tree", day, f"hour-{HOUR}.parquet")
    assert compaction.compact_hour(spark, store, HOUR, HOUR + HOUR_MS) == {day: "merged"}
    assert f"hour-{HOUR}.parquet.unreadable" in store.names("tree", day)


def test_retention(spark, store):
    days = [f"date={d}" for d in ("2026-08-23", "2026-08-24", "2026-08-25", "2026-08-26", "2026-08-27", "2026-08-28", "2027-06-19")]
    for d in days:
        store.write_text("", "tree", d, "1.parquet")
    gone = retention.expire(store, T + 5 * DAY_MS + DAY_MS // 2, 2)
    assert gone.removed == days[:3] and not gone.failures
    frame = spark.createDataFrame([(T + k * DAY_MS,) for k in range(4)], "day long")
    assert sorted((r["day"] - T) // DAY_MS for r in retention.expired_days(frame, T + 365 * DAY_MS, 2).collect()) == [0]
    assert retention.expire(Store(spark, store.at("nothing")), T, 2).removed == []


def test_snapshot_bound(spark, store):
    roll.append_batch(store, table(spark, row(0, "quiet", 1), row(3 * DAY_MS, "busy", 3), row(6 * DAY_MS, "busy", 6), row(0, "p", 1), row(6 * DAY_MS, "p", 6)), 0)
    roll.roll_once(spark, store, T + 7 * DAY_MS)
    at = {r["path"]: r["value_num"] for r in tree.snapshot_at(spark, store, T + 4 * DAY_MS).collect()}
    assert at == {"quiet": 1.0, "busy": 3.0}  # p moved on later and was last seen before the days that are read
    assert {r["path"]: r["value_num"] for r in tree.snapshot_at(spark, store, T + 7 * DAY_MS).collect()} == {"quiet": 1.0, "busy": 6.0, "p": 6.0}


def test_paths_stay_below_the_root(store):
    for bad in ("../x", "a/../../b", "a//b"):
        with pytest.raises(ValueError):
            store.at(bad)


def test_maintenance_and_sweep(spark, store):
    rolls(spark, store, 2)
    store.write_text("", "_roll-1", "x")
    done = maintenance_slot(spark, store, HOUR + HOUR_MS, retention_days=30)
    assert done["rolled"] is None and done["merged"] == {"date=2026-08-23": "merged"} and done["swept"] == []
    assert retention.sweep(store, 2**52) == ["_roll-1"]


def test_missing_columns_are_null_and_foreign_files_ignored(spark, store):
    table(spark, row(0)).select("ts", "context", "path", "value_kind").coalesce(1).write.parquet(store.at("_w"))
    part = next(n for n in store.names("_w") if n.endswith(".parquet"))
    store.rename(f"_w/{part}", "tree/date=2026-08-23/5.parquet")
    store.write_text("junk", "tree", "date=2026-08-23", "6.parquet.tmp")
    (found,) = tree.rows_between(spark, store, T, T + 5).collect()
    assert found["source"] is None and found["value_num"] is None


def test_lines(spark):
    good = {"ts": 1, "context": "self", "path": "a", "value_kind": "number", "value_num": 2.5}
    rows = [(json.dumps(good),), ("{",), (json.dumps(good | {"value_kind": "x"}),), (None,)]
    ok, bad = parse_lines(spark.createDataFrame(rows, "value string"))
    assert [r["value_num"] for r in ok.collect()] == [2.5] and bad.count() == 3


def test_sqlite_store(spark, tmp_path):
    path = str(tmp_path / "hot.db")
    with sqlite3.connect(path) as base:
        base.execute("CREATE TABLE sample (ts INTEGER, context TEXT, path TEXT, source TEXT, value_kind TEXT, value_num REAL, value_str TEXT, value_lat REAL, value_lon REAL)")
        base.executemany("INSERT INTO sample VALUES (?,?,?,?,?,?,?,?,?)", [row(k, ("a.b", "c.d")[k % 2], k) for k in range(20)])
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    frame = spark.read.format("tidelake_sqlite").option("path", path).option("partitions", 3).load()
    assert frame.columns == HOT.names and frame.where((F.col("ts") >= T + 10) & (F.col("path") == "a.b")).count() == 5


def test_storage_over_the_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    whole = adapters.samples(spark, sf_dir).select(*COLUMNS).cache()
    keys = whole.select("context", "path").distinct().count()
    for name in ("seam_union_whole", "compaction_invariant_whole"):
        got = QUERIES[name](spark, sf_dir).cache()
        assert got.count() == whole.count() and got.exceptAll(whole).isEmpty(), name
    assert QUERIES["roll_days_whole"](spark, sf_dir).agg(F.sum("n")).first()[0] == whole.count()
    assert QUERIES["sidecar_fold_whole"](spark, sf_dir).count() == keys == QUERIES["snapshot_tiers_whole"](spark, sf_dir).count()
    left = adapters.samples(spark, sf_dir).where("rowid % 3 <> 0").select(*COLUMNS)
    assert QUERIES["except_all_missing_whole"](spark, sf_dir).count() == whole.count() - left.count()


def test_stored_samples_answer_as_generated_ones(spark, tmp_path):
    from tidelake.queries import QUERIES
    from tidelake.sources import adapters

    events = spark.range(400).selectExpr("id as event_id", "timestamp_millis(1704240000000 + id * 3600000) as ts", "id % 20 as user_id", "'view' as event_type", "cast(id as double) as value", "'{\"k\": 1}' as props")
    events.write.parquet(str(tmp_path / "sf" / "events.parquet"))
    sf_dir, names = str(tmp_path / "sf"), ("range_paths", "snapshot_now", "snapshot_past", "bucket_average", "list_paths")

    def answers():
        return {n: sorted(map(str, QUERIES[n](spark, sf_dir).collect())) for n in names}

    made = answers()
    adapters.store(spark, sf_dir, f"file://{tmp_path}/kept")
    try:
        assert answers() == made and all(made.values())
        plan = QUERIES["range_paths"](spark, sf_dir)._jdf.queryExecution().toString()
        assert "PartitionFilters: [isnotnull(date" in plan and "In(path" in plan
    finally:
        adapters._stored.clear()
