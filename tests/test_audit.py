from __future__ import annotations

from datetime import datetime

from frames import at, readings, rows
from pyspark.sql import functions as F

from thermaline.operators import audit
from thermaline.schema import PERIODS


def frame(spark):
    return readings(
        spark,
        [
            (1, 1, 0, 1.0, None, 3.0, "a"),
            (1, 1, 1440, None, None, 3.0, "b"),
            (1, 1, 1450, 1.0, 2.0, 3.0, "a"),
            (1, 9, 0, 1.0, 2.0, 3.0, None),
            (2, 4, 30 * 1440, 1.0, 2.0, 3.0, "c"),
            (2, 17, 5, 1.0, 2.0, 3.0, "c"),
        ],
    )


def test_missing_reports(spark):
    r = frame(spark)
    got = {x["file"]: x for x in audit.missing_profile(r).collect()}
    one = got["GW_1.1_111025.csv"]
    assert (one["missing_internal_temp"], one["missing_surface_temp"]) == (2, 1)
    assert round(one["missing_internal_temp_pct"], 3) == 66.667
    by_column = rows(
        audit.missing_by_column(r).where("file = 'GW_1.1_111025.csv'"),
        "measure", "n_missing", "total_missing", "verdict",
    )
    assert by_column == [
        ("internal_temp", 2, 3, "listed"), ("room_temp", 0, 3, "listed"),
        ("surface_temp", 1, 3, "listed"), ("wall_type", 0, 3, "listed"),
    ]
    assert rows(audit.rows_with_missing(r), "file_order", "n_missing") == [(0, 1), (1, 2), (3, 1)]


def test_files_with_many_gaps_list_no_rows(spark):
    many = readings(spark, [(1, 1, m, None, 2.0, 3.0, "a") for m in range(10)])
    nine = readings(spark, [(1, 2, m, None, 2.0, 3.0, "a") for m in range(9)])
    assert rows(audit.rows_with_missing(many.union(nine)).select("file").distinct(), "file") == [
        ("GW_1.2_111025.csv",)
    ]
    by_column = audit.missing_by_column(many)
    assert rows(by_column.select("verdict").distinct(), "verdict") == [("too many",)]


def test_mapping_and_distribution(spark):
    r = frame(spark)
    got = {x["file"]: x for x in audit.sensor_mapping(r).collect()}
    assert got["GW_1.1_111025.csv"]["wall_types"] == "a, b"
    assert got["GW_1.1_111025.csv"]["rows"] == 3
    assert got["GW_1.9_111025.csv"]["wall_types"] == "N/A"
    assert got["GW_1.9_111025.csv"]["n_wall_types"] == 0
    assert got["GW_2.17_111025.csv"]["wall_id"] is None
    shares = rows(
        audit.type_distribution(r).where("file = 'GW_1.1_111025.csv'"), "wall_type", "n"
    )
    assert shares == [("a", 2), ("b", 1)]


def test_long_type_lists_are_cut(spark):
    names = ["Exposed", "Yarka", "Dry soil", "Succalents", "Wet soil"]
    r = readings(spark, [(1, 1, m, 1.0, 1.0, 1.0, n) for m, n in enumerate(names)])
    (row,) = audit.sensor_mapping(r).collect()
    assert row["wall_types"] == "Exposed, Yarka, Dry soil,..." and row["n_wall_types"] == 5


def test_sensor_sets(spark):
    r = frame(spark)
    got = {(x["period"], x["box_id"]): x for x in audit.sensor_availability(r).collect()}
    assert got["Period1", 1]["found"] == "1,9" and got["Period1", 1]["n_missing"] == 14
    assert got["Period1", 2]["found"] == "4,17" and got["Period1", 2]["n_found"] == 2
    assert got["Period1", 2]["n_missing"] == 15
    missing = rows(audit.missing_sensors(r).where("box_id = 2 and period = 'Period1'"), "sensor_id")
    assert [s for (s,) in missing] == [s for s in range(1, 17) if s != 4]
    absent = audit.missing_sensors(r.where("box_id = 1")).where("box_id = 2 or period = 'Period2'")
    assert absent.count() == 3 * 16
    walls = rows(audit.coverage(r), "box_id", "wall_id", "n_sensors", "out_sensors", "in_sensors")
    assert walls == [(1, 1, 2, "1", "9"), (2, 2, 1, "4", "")]


def test_boxes_without_sensors_have_a_line(spark):
    r = frame(spark).withColumn("sensor_id", F.when(F.col("box_id") == 1, F.col("sensor_id")))
    got = rows(audit.sensor_availability(r), "period", "box_id", "n_found", "n_missing", "found")
    assert got == [
        ("Period1", 1, 2, 14, "1,9"), ("Period1", 2, 0, 16, ""), ("Period2", 1, 0, 16, ""), ("Period2", 2, 0, 16, ""),
    ]


def test_missing_sensors_on_the_grid_of_all_bins(spark):
    periods = [("Period1", datetime(2025, 10, 23), datetime(2025, 10, 23, 0, 29, 59))]
    levels = spark.createDataFrame(
        [("Period1", 1, datetime(2025, 10, 23, 0, 10), s) for s in (1, 2, 17)] + [("Period1", 2, datetime(2025, 10, 24), 1)],
        "period string, box_id int, timestamp timestamp_ntz, sensor_id int",
    )
    got = audit.missing_sensors_on_grid(levels, "10 minutes", periods)
    assert got.count() == 3 * 2 * 16 - 2
    held = rows(got.where("box_id = 1 and minute(timestamp) = 10"), "sensor_id")
    assert [s for (s,) in held] == list(range(3, 17))


def test_failed_files_count_in_the_report(spark):
    r = frame(spark)
    status = spark.createDataFrame(
        [("Period1", "good", 1, 1, None), ("Period1", "bad", 1, 2, "no header"), ("Period1", "odd", None, None, "unparsable name"),
         ("Period2", "lost", 2, 1, "no header")],
        "period string, file string, box_id int, sensor_id int, reason string",
    )
    report = audit.audit_report(r, status)
    assert rows(report.where("level = 'period'"), "period", "n_files", "n_failed", "rows") == [
        ("Period1", 6, 2, 6), ("Period2", 1, 1, 0),
    ]
    assert rows(report.where("level = 'box'"), "period", "box_id", "n_files", "n_failed") == [
        ("Period1", 1, 3, 1), ("Period1", 2, 2, 0), ("Period2", 2, 1, 1),
    ]
    assert "n_failed" not in audit.audit_report(r).columns
    assert rows(audit.failed_files(status), "file") == [("bad",), ("lost",), ("odd",)]


def test_period_and_sensor_summary(spark):
    r = frame(spark)
    (p,) = audit.period_summary(r).collect()
    assert (p["rows"], p["n_sensors"], p["n_boxes"], p["duration_days"]) == (6, 4, 2, 30)
    assert rows(audit.sensor_summary(r), "sensor_id", "rows", "wall_id") == [
        (1, 3, 1), (4, 1, 2), (9, 1, 1), (17, 1, None),
    ]


def test_range_reports(spark):
    r = frame(spark)
    got = {x["file"]: x for x in audit.range_check(r).collect()}
    assert got["GW_2.4_111025.csv"]["invalid_rows"] == 1
    assert got["GW_2.4_111025.csv"]["invalid_times"] == "2025-11-22 00:00:00"
    assert got["GW_1.1_111025.csv"]["percent_valid"] == 100.0
    assert got["GW_1.1_111025.csv"]["invalid_times"] is None
    audit_rows = {x["file"]: x for x in audit.range_audit(r).collect()}
    assert audit_rows["GW_2.4_111025.csv"]["other_start_day"] is True
    assert audit_rows["GW_1.1_111025.csv"]["other_start_day"] is False
    assert audit_rows["GW_1.1_111025.csv"]["very_few_rows"] is True
    times = rows(audit.missing_times(r), "measure", "missing_at")
    assert times == [
        ("internal_temp", "2025-10-23 00:00:00, 2025-10-24 00:00:00"),
        ("surface_temp", "2025-10-24 00:00:00"), ("wall_type", "2025-10-23 00:00:00"),
    ]


def test_invalid_times_are_listed_below_ten_only(spark):
    late = [(1, 1, 40 * 1440 + m, 1.0, 1.0, 1.0, "a") for m in range(9)]
    got = audit.range_check(readings(spark, late)).collect()[0]
    assert got["invalid_rows"] == 9 and got["invalid_times"].count(",") == 8
    late.append((1, 1, 50 * 1440, 1.0, 1.0, 1.0, "a"))
    got = audit.range_check(readings(spark, late)).collect()[0]
    assert got["invalid_rows"] == 10 and got["invalid_times"] is None


def test_bounded_lists_are_limited_before_the_shuffle(spark):
    plan = audit.range_check(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_rollups(spark):
    r = frame(spark)
    got = rows(
        audit.valid_rollup(r).where("box_id = 2 and period = 'Period1'"), "wall_id", "n_files", "rows", "valid_rows",
        "n_expected",
    )
    assert got == [(1, 0, 0, 0, 4), (2, 1, 1, 0, 4), (3, 0, 0, 0, 4), (4, 0, 0, 0, 4), (None, 2, 2, 1, 16)]
    assert audit.valid_rollup(r).where("period = 'Period2' and n_files = 0").count() == 10
    report = audit.audit_report(r)
    assert rows(report.where("level = 'period'"), "n_files", "rows", "missing_internal_temp") == [
        (4, 6, 2)
    ]
    assert rows(report.where("level = 'wall'"), "box_id", "wall_id", "rows") == [
        (1, 1, 4), (2, 2, 1),
    ]
    (box_one,) = report.where("level = 'box' and box_id = 1").collect()
    assert box_one["missing_sensors"] == "2,3,4,5,6,7,8,10,11,12,13,14,15,16"
    (ready,) = audit.readiness(r).collect()
    assert tuple(ready) == (True, False, False)
    assert [p[0] for p in PERIODS] == ["Period1", "Period2"]


def test_days_profile_and_first_rows(spark):
    r = frame(spark)
    days = rows(
        audit.rows_per_day(r, expected=2).where("file = 'GW_1.1_111025.csv'"),
        "day", "rows", "as_expected", "avg_per_day",
    )
    assert days == [(at(0).date(), 1, False, 1.5), (at(1440).date(), 2, True, 1.5)]
    profile = {x["file"]: x for x in audit.file_profile(r).collect()}
    assert profile["GW_1.1_111025.csv"]["null_count"] == 3
    assert profile["GW_1.9_111025.csv"]["null_count"] == 1
    assert profile["GW_2.17_111025.csv"]["has_nulls"] is False
    assert rows(audit.first_readings(r), "file_order") == [(0,), (3,), (4,), (5,)]


def test_overview_counts_all_levels_in_one_pass(spark):
    from thermaline.plans.flows import build_levels

    levels = build_levels(frame(spark))
    got = rows(audit.overview(levels.sensor), "level", "rows", "n_periods", "n_items")
    assert got == [
        ("box", levels.box.count(), 1, 2), ("sensor", levels.sensor.count(), 1, 4),
        ("wall", levels.wall.count(), 1, 2),
    ]
    plan = audit.overview(levels.sensor)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") <= 2


def test_failed_files_are_in_the_profile(spark):
    files = spark.createDataFrame(
        [("Period1", "a", "no header", 0), ("Period1", "b", "ragged row", 0), ("Period1", "c", None, 3)],
        "period string, file string, reason string, rows bigint",
    )
    profile = audit.file_profile(frame(spark), files)
    assert rows(profile.where("status <> 'SUCCESS'"), "file", "status", "rows") == [
        ("a", "FAILED", 0), ("b", "ERROR", 0),
    ]
