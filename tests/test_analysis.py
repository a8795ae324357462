from __future__ import annotations

import statistics

import numpy as np
import pytest
from frames import at, readings, rows
from pyspark.sql import functions as F

from thermaline.functions.columns import box_name, measure, round_half_even
from thermaline.operators import analysis, selection
from thermaline.plans.flows import answer, build_levels


@pytest.fixture(scope="module")
def lv(spark):
    data = []
    for box in (1, 2):
        for sensor in (1, 2, 3, 9, 10, 11):
            for k in range(4):
                kind = "Exposed" if box == 1 or k < 2 else "Yarka"
                base = 10.0 * box + sensor + k
                data.append((box, sensor, 10 * k, base, base / 2, 5.0 + k, kind))
    return build_levels(readings(spark, data))


def collected(df):
    return [r.asDict() for r in df.collect()]


def test_round_half_even(spark):
    df = spark.createDataFrame([(0.25,), (0.35,), (1.05,), (None,)], "x double")
    got = [r["y"] for r in df.select(round_half_even(F.col("x"), 1).alias("y")).collect()]
    assert got == [0.2, 0.4, 1.0, None]


def test_gradient_by_type_is_ordered_and_complete(lv):
    got = collected(analysis.gradient_by_type(lv.wall))
    assert [r["total_gradient"] for r in got] == sorted(r["total_gradient"] for r in got)
    wall = collected(lv.wall)
    for r in got:
        mine = [w for w in wall if w["wall_type"] == r["wall_type"]]
        assert r["room_temp"] == pytest.approx(statistics.mean(w["room_temp"] for w in mine))
        assert r["surface_gradient"] == pytest.approx(r["out_surface"] - r["in_surface"])
        assert r["total_gradient"] == pytest.approx(r["room_temp"] - r["in_internal"])


def test_gradient_drops_types_without_all_measures(spark):
    lv = build_levels(
        readings(spark, [(1, 1, 0, 1.0, 2.0, 3.0, "half"), (1, 3, 0, 1.0, 2.0, 3.0, "full"),
                         (1, 11, 0, 4.0, 5.0, 3.0, "full"), (2, 3, 0, 1.0, 2.0, 3.0, None)])
    )
    assert rows(analysis.gradient_by_type(lv.wall), "wall_type") == [("full",)]


def test_delta_series_signs(lv):
    raw = {(r["wall_type"], r["timestamp"]): r for r in collected(analysis.delta_series(lv.wall))}
    relative = collected(analysis.delta_series(lv.wall, ["Period1"], normalized=True))
    assert len(relative) == len(raw) == 6
    for r in relative:
        same = raw[r["wall_type"], r["timestamp"]]
        assert r["surface_delta"] == pytest.approx(same["surface_delta"])
        assert r["total_delta"] == pytest.approx(same["total_delta"])
    assert analysis.delta_series(lv.wall, ["Period2"]).count() == 0


def test_relationship_views(lv):
    raw = rows(analysis.relationship(lv.wall, "room_temp", "room_temp"), "x_binned", "y_mean")
    assert all(x == y for x, y in raw)
    zero = collected(analysis.relationship(lv.wall, "room_temp", "in_surface", normalized=True))
    assert {r["x_binned"] for r in zero} == {0.0}
    assert sum(r["n"] for r in zero) == lv.wall.count()
    on_y = collected(analysis.relationship(lv.wall, "in_surface", "room_temp", normalized=True))
    assert all(5.0 <= r["y_mean"] <= 8.0 for r in on_y)


def test_correlation_matrix_equals_numpy(lv):
    box = collected(lv.box)

    def series(box_id, name):
        mine = sorted((b["timestamp"], b[name]) for b in box if b["box_id"] == box_id)
        return np.array([v for _, v in mine])

    cells = {(r["row_name"], r["column_name"]): r["r"]
             for r in collected(analysis.correlation_matrix(lv.box))}
    assert len(cells) == 25
    expected = np.corrcoef(series(1, "internal_temp"), series(2, "surface_temp"))[0, 1]
    assert cells["Control_internal", "Experimental_surface"] == pytest.approx(expected)
    assert cells["Control_room", "Control_room"] == 1.0


def test_correlation_of_constants_is_null(spark):
    lv = build_levels(readings(spark, [(b, 9, 10 * k, 1.0, float(k), 2.0, "a")
                                       for b in (1, 2) for k in range(3)]))
    cells = {(r["row_name"], r["column_name"]): r["r"]
             for r in collected(analysis.correlation_matrix(lv.box))}
    assert cells["Control_surface", "Control_internal"] is None
    assert cells["Control_surface", "Control_surface"] is None
    assert cells["Control_internal", "Experimental_internal"] == pytest.approx(1.0)


def test_summary_table_uses_sample_deviation(lv):
    wall = [w for w in collected(lv.wall) if w["wall_type"] == "Yarka"]
    (got,) = [r for r in collected(analysis.summary_table(lv.wall)) if r["wall_type"] == "Yarka"]
    values = [w["in_normalized_internal"] for w in wall]
    assert statistics.mean(values) == 8.875 and got["in_normalized_internal_mean"] == 8.88
    assert got["in_normalized_internal_std"] == round(statistics.stdev(values), 2)


def test_box_detail_equals_join_of_levels(lv):
    outside = lv.wall.groupBy("period", "box_id", "timestamp").agg(
        F.avg("out_surface").alias("o")
    )
    joined = lv.box.join(outside, ["period", "box_id", "timestamp"], "left")
    expected = rows(joined, "box_id", "timestamp", "internal_temp", "surface_temp", "o", "room_temp")
    got = rows(
        analysis.box_detail_profile(lv.sensor),
        "box_id", "timestamp", "internal", "inside_surface", "outside_surface", "room",
    )
    assert [r[:2] for r in got] == [r[:2] for r in expected]
    for g, e in zip(got, expected):
        assert g[2:] == pytest.approx(e[2:])
    assert {r["room"] for r in collected(analysis.box_detail_profile(lv.sensor, True))} == {0.0}


def test_sensor_deviation_sums_to_zero(lv):
    chosen = selection.in_box(lv.sensor, 1, sensors=[1, 2])
    got = rows(analysis.sensor_vs_box_mean(chosen, "surface_temp"), "timestamp", "deviation")
    assert {d for _, d in got} == {-0.5, 0.5} and len(got) == 8


def test_wall_views(lv):
    comparison = collected(analysis.wall_comparison(lv.wall))
    assert len(comparison) == 8
    for r in comparison:
        assert r["experimental_surface"] - r["control_surface"] == pytest.approx(10.0)
    shown = analysis.wall_timeline(lv.wall, 2, [1])
    assert shown.count() == 4
    mean = collected(analysis.wall_internal_mean(lv.wall, 2, [1, 2]))
    assert len(mean) == 4 and mean[0]["in_internal"] is not None
    assert analysis.room_mean(lv.box).count() == 4
    assert analysis.profile_by_type(lv.wall, 1).count() == 4


def test_smoothed_measures_are_picked_up(lv):
    shown = answer(lv, smoothing="1h")
    assert "internal_temp_smooth" in shown.box.columns and "out_surface_smooth" in shown.wall.columns
    smooth = rows(analysis.box_timeline(shown.box, smoothed=True), "box_name", "timestamp", "internal")
    plain = rows(analysis.box_timeline(lv.box), "box_name", "timestamp", "internal")
    assert [r[:2] for r in smooth] == [r[:2] for r in plain]
    assert smooth[0][2] == plain[0][2]
    assert smooth[1][2] == pytest.approx((plain[0][2] + plain[1][2]) / 2)
    assert str(measure(shown.wall, "in_internal", smoothed=True)._jc) == "in_internal_smooth"
    assert str(measure(shown.wall, "out_surface", True, True)._jc) == "out_normalized_surface"


def test_filters(spark, lv):
    assert selection.in_periods(lv.box, ["Period1"]).count() == lv.box.count()
    assert selection.in_period(lv.box, None) is lv.box
    assert selection.in_box(lv.wall, 2, wall_type="Yarka").count() == 4
    periods = [("Period1", at(10), at(20))]
    assert selection.in_period_range(lv.box, periods).count() == 4
    names = spark.createDataFrame([(1,), (2,), (3,)], "b int").select(box_name(F.col("b")).alias("n"))
    assert [r["n"] for r in names.collect()] == ["Control", "Experimental", None]
