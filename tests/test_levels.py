from __future__ import annotations

import pytest
from frames import at, readings, rows

from thermaline.operators import levels
from thermaline.plans.flows import Levels, answer, build_levels, save_sensor_level


def test_resample_means_mode_and_bins(spark):
    r = readings(
        spark,
        [
            (1, 1, 0, 10.0, 20.0, 5.0, "b"),
            (1, 1, 9, 14.0, None, 5.0, "a"),
            (1, 1, 10, 1.0, None, None, None),
            (1, 1, 19, 3.0, None, None, None),
            (1, 1, 25, 7.0, 1.0, 1.0, "c"),
            (1, 1, 26, 7.0, 1.0, 1.0, "c"),
            (1, 1, 27, 7.0, 1.0, 1.0, "a"),
        ],
    )
    got = rows(
        levels.resample(r), "timestamp", "surface_temp", "internal_temp", "room_temp", "wall_type"
    )
    assert got == [
        (at(0), 12.0, 20.0, 5.0, "a"),
        (at(10), 2.0, None, None, None),
        (at(20), 7.0, 1.0, 1.0, "c"),
    ]


def test_modal_value_ties_and_nulls(spark):
    df = spark.createDataFrame(
        [(1, "b"), (1, "a"), (1, None), (1, None), (2, None), (3, "z"), (3, "z"), (3, "a")],
        "k int, v string",
    )
    assert rows(levels.modal_value(df, ["k"], "v"), "k", "v") == [(1, "a"), (2, None), (3, "z")]


def test_topology_covers_sixteen_sensors_and_leaves_others_null(spark):
    df = spark.createDataFrame([(s,) for s in range(1, 18)], "sensor_id int")
    got = rows(levels.with_topology(df), "sensor_id", "wall_id", "position")
    assert got[0] == (1, 1, "out") and got[8] == (9, 1, "in") and got[15] == (16, 4, "in")
    assert got[16] == (17, None, None)
    assert sum(1 for _, _, p in got if p == "out") == 8


def test_wall_presence_rules(spark):
    r = readings(
        spark,
        [
            # wall 1: only an inside sensor
            (1, 9, 0, 30.0, 31.0, 20.0, "in type"),
            # wall 2: both sides, the outside room is missing
            (1, 3, 0, 40.0, 41.0, None, "out type"),
            (1, 11, 0, 30.0, 33.0, 25.0, None),
            # wall 3: only an outside sensor
            (1, 5, 0, 50.0, 51.0, 22.0, "out type"),
            # no wall
            (1, 17, 0, 99.0, 99.0, 99.0, "none"),
        ],
    )
    wall = build_levels(r).wall
    got = {w["wall_id"]: w for w in wall.collect()}
    assert set(got) == {1, 2, 3}
    assert got[1]["out_surface"] is None and got[1]["out_sensor_count"] is None
    assert got[1]["room_temp"] == 20.0 and got[1]["wall_type"] == "in type"
    assert got[1]["total_gradient"] is None and got[1]["internal_avg"] is None
    assert got[2]["room_temp"] is None and got[2]["wall_type"] is None
    assert got[2]["surface_gradient"] == 10.0 and got[2]["gradient_out_to_in_surface"] == -10.0
    assert got[2]["internal_avg"] == 37.0 and got[2]["gradient_in_surface_to_internal"] == 7.0
    assert got[2]["internal_gradient"] == 8.0
    assert got[3]["wall_type"] == "out type" and got[3]["room_temp"] == 22.0
    assert got[3]["in_sensor_count"] is None and got[3]["gradient_air_to_out_surface"] == 28.0


def test_wall_means_of_sensor_means(spark):
    r = readings(
        spark,
        [
            (1, 1, 0, 10.0, 1.0, 0.0, "a"),
            (1, 1, 1, 20.0, 1.0, 0.0, "a"),
            (1, 1, 2, 30.0, 1.0, 0.0, "a"),
            (1, 2, 0, 40.0, 1.0, 0.0, "b"),
        ],
    )
    (w,) = build_levels(r).wall.collect()
    assert w["out_surface"] == 30.0 and w["out_sensor_count"] == 2
    assert w["wall_type"] == "a"


def test_box_level_surface_from_inside_only(spark):
    r = readings(
        spark,
        [
            (1, 1, 0, 100.0, 10.0, 4.0, "a"),
            (1, 9, 0, 30.0, 20.0, 6.0, "a"),
            (1, 17, 0, 50.0, 60.0, 5.0, "a"),
        ],
    )
    (b,) = build_levels(r).box.collect()
    assert (b["surface_temp"], b["internal_temp"], b["room_temp"]) == (30.0, 30.0, 5.0)
    assert b["sensor_count"] == 3 and b["normalized_surface"] == 24.0
    assert b["normalized_internal"] == pytest.approx((6 + 14 + 55) / 3)


def test_level_counts_keep_the_expected_ratio(spark):
    r = readings(
        spark,
        [
            (box, s, 10 * k + 3, 1.0, 2.0, 3.0, "a")
            for box in (1, 2)
            for s in range(1, 17)
            for k in range(6)
        ],
    )
    lv = build_levels(r)
    assert (lv.sensor.count(), lv.wall.count(), lv.box.count()) == (192, 48, 12)
    completeness = levels.bin_completeness(lv.sensor)
    assert rows(completeness, "n_values", "complete") == [(32, True)] * 6
    assert rows(levels.bin_count_histogram(completeness), "n_values", "n_bins") == [(32, 6)]
    assert levels.incomplete_bins(completeness).count() == 0


def test_exclusion_reaggregates(spark):
    r = readings(
        spark,
        [
            (1, 1, 0, 10.0, 10.0, 0.0, "a"),
            (1, 2, 0, 30.0, 30.0, 0.0, "a"),
            (2, 1, 0, 50.0, 50.0, 0.0, "a"),
        ],
    )
    shown = answer(build_levels(r), period="Period1", excluded=[(1, 2), (2, 1)])
    assert rows(shown.wall, "box_id", "out_surface") == [(1, 10.0)]
    assert rows(shown.box, "box_id", "internal_temp") == [(1, 10.0)]
    assert answer(build_levels(r), period="Period9").box.count() == 0


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rollups_add_no_exchange(spark):
    r = readings(spark, [(1, 1, 0, 10.0, 10.0, 0.0, "a")])
    lv = build_levels(r)
    base = _plan(lv.sensor).count("Exchange hashpartitioning")
    assert base == 2
    assert _plan(lv.wall).count("Exchange hashpartitioning") == base
    assert _plan(lv.box).count("Exchange hashpartitioning") == base
    assert "BroadcastHashJoin" in _plan(lv.wall) and "SinglePartition" not in _plan(lv.wall)


def test_saved_sensor_level_rolls_up_without_exchange(spark, tmp_path):
    r = readings(
        spark, [(b, s, m, 1.0, 2.0, 3.0, "a") for b in (1, 2) for s in (1, 9) for m in (0, 10)]
    )
    sensor = build_levels(r).sensor
    spark.sql(f"CREATE DATABASE IF NOT EXISTS kept LOCATION '{tmp_path}/kept'")
    saved = save_sensor_level(sensor, "kept.sensor_level", 4)
    again = answer(Levels(saved), excluded=[(2, 9)])
    assert "Exchange hashpartitioning" not in _plan(again.wall)
    assert "Exchange hashpartitioning" not in _plan(again.box)
    assert again.wall.count() == 4 and again.box.count() == 4
