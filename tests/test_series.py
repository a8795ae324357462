from __future__ import annotations

import random
from datetime import datetime

import numpy as np
import pytest
from frames import at, rows
from pyspark.sql import functions as F

from thermaline.functions.timebins import floor_to, from_micros, micros
from thermaline.operators import lag as lag_module
from thermaline.operators import series
from thermaline.operators.chunks import row_positions
from thermaline.operators.lag import thermal_lag


def timed(spark, values, key="k"):
    return spark.createDataFrame(
        [(key, at(m), v) for m, v in values], "key string, timestamp timestamp_ntz, x double"
    )


@pytest.mark.parametrize("tested", ["UTC", "America/New_York"])
def test_micros_round_trip_in_any_zone(spark, tested):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", tested)
        df = spark.createDataFrame(
            [(datetime(2025, 3, 9, 2, 30),), (datetime(1969, 12, 31, 23, 59, 58, 123456),)],
            "t timestamp_ntz",
        )
        got = df.select("t", micros(F.col("t")).alias("u"), from_micros(micros(F.col("t"))).alias("b"))
        for t, u, b in got.collect():
            delta = t - datetime(1970, 1, 1)
            assert u == (delta.days * 86400 + delta.seconds) * 1_000_000 + delta.microseconds
            assert b == t
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_smoothing_is_open_at_the_left(spark):
    df = timed(spark, [(0, 1.0), (30, 5.0), (60, 7.0)])
    got = rows(series.smooth(df, ["x", "absent"], "1h", ["key"]), "timestamp", "x_smooth")
    assert got == [(at(0), 1.0), (at(30), 3.0), (at(60), 6.0)]


def test_smoothing_skips_nulls_and_none_is_no_op(spark):
    df = timed(spark, [(0, None), (10, 4.0), (20, None)])
    got = rows(series.smooth(df, ["x"], "1h", ["key"]), "timestamp", "x_smooth")
    assert got == [(at(0), None), (at(10), 4.0), (at(20), 4.0)]
    assert series.smooth(df, ["x"], None, ["key"]).columns == df.columns


@pytest.mark.parametrize(
    "window,span", [("1h", 60), ("12h", 720), ("1d", 1440), ("25h", 1500), ("2d", 2880), ("3d", 4320), ("30d", 43200)]
)
def test_smoothing_across_chunks_equals_brute_force(spark, window, span):
    rng = random.Random(7)
    minutes = sorted(rng.sample(range(0, 20 * 1440, 5), 700))
    data = {key: [(m, rng.random()) for m in minutes] for key in ("a", "b")}
    df = timed(spark, data["a"], "a").union(timed(spark, data["b"], "b"))
    got = {
        (r["key"], r["timestamp"]): r["x_smooth"]
        for r in series.smooth(df, ["x"], window, ["key"]).collect()
    }
    assert len(got) == 1400
    for key, values in data.items():
        for m, _ in values:
            inside = [v for t, v in values if m - span < t <= m]
            assert got[key, at(m)] == pytest.approx(sum(inside) / len(inside))


@pytest.mark.parametrize("days", [1.5, 5, 9.25])
def test_wide_smoothing_with_ties_nulls_and_infinite_values(spark, days):
    rng = random.Random(11)
    span = int(days * 1440)
    values = [None, float("inf"), *[round(rng.uniform(-50, 50), 2) for _ in range(20)]]
    data = [
        (key, None if rng.random() < 0.02 else rng.randrange(0, 60 * 1440, 240), rng.choice(values))
        for key in ("a", None)
        for _ in range(500)
    ]
    df = spark.createDataFrame(
        [(i, k, None if m is None else at(m), v) for i, (k, m, v) in enumerate(data)],
        "id int, key string, timestamp timestamp_ntz, x double",
    )
    smoothed = series.smooth(df, ["x"], f"{span}min", ["key"])
    assert smoothed.columns == ["id", "key", "timestamp", "x", "x_smooth"]
    got = {r["id"]: r["x_smooth"] for r in smoothed.collect()}
    assert len(got) == len(data)
    for i, (key, m, _) in enumerate(data):
        inside = [
            v
            for k, t, v in data
            if m is not None and t is not None and k == key and m - span < t <= m and v is not None
        ]
        assert got[i] == (pytest.approx(sum(inside) / len(inside)) if inside else None)


def test_no_frame_over_rows_grows_with_a_wide_window(spark):
    df = timed(spark, [(m, 1.0) for m in range(0, 100)])
    plan = series.smooth(df, ["x"], "365d", ["key"])._jdf.queryExecution().optimizedPlan().toString()
    frames = [line for line in plan.splitlines() if "windowspecdefinition" in line]
    over_rows = [line for line in frames if "_series" not in line.split("windowspecdefinition(")[1]]
    assert over_rows and all("unboundedpreceding" in line for line in over_rows)


def test_wide_smoothing_of_no_rows(spark):
    df = timed(spark, [])
    assert series.smooth(df, ["x"], "30d", ["key"]).collect() == []


def typed(spark, kinds, step=10):
    return spark.createDataFrame(
        [("k", at(i * step), kind, float(i)) for i, kind in enumerate(kinds)],
        "key string, timestamp timestamp_ntz, wall_type string, a_surface double",
    )


def test_change_events_and_regimes(spark):
    df = typed(spark, ["a", "a", "b", "b", "a"])
    events = rows(series.change_events(df, ["key"]), "timestamp", "wall_type")
    assert events == [(at(0), "a"), (at(20), "b"), (at(40), "a")]
    regimes = rows(series.with_regimes(df, ["key"]), "timestamp", "regime_id")
    assert [r for _, r in regimes] == [1, 1, 2, 2, 3]


def test_rows_with_null_keys_are_a_series_of_their_own(spark):
    df = spark.createDataFrame(
        [(1, at(0), "a"), (None, at(0), "a"), (None, at(10), "b"), (1, at(50), "a"), (None, at(60), "b")],
        "key int, timestamp timestamp_ntz, wall_type string",
    )
    got = rows(series.with_regimes(df, ["key"], chunk="30 minutes"), "key", "timestamp", "regime_id")
    assert got == [(1, at(0), 1), (1, at(50), 1), (None, at(0), 1), (None, at(10), 2), (None, at(60), 2)]
    assert series.treatment_runs(df, ["key"]).where("key is null").count() == 2
    placed = row_positions(df, ["key"], ["timestamp"], F.minute("timestamp") >= 30)
    assert rows(placed.where("key is null"), "timestamp", "row_index") == [(at(0), 0), (at(10), 1), (at(60), 2)]


@pytest.mark.parametrize("chunk", ["30 minutes", "70 minutes", "30 days"])
def test_regimes_do_not_depend_on_chunks(spark, chunk):
    rng = random.Random(3)
    kinds = [rng.choice(["a", "a", "a", "b", None]) for _ in range(200)]
    # long quiet stretches, so that a regime spans several chunks
    kinds += ["c"] * 60 + [None] * 30 + ["c"] * 10
    expected, regime, last = [], 0, object()
    for kind in kinds:
        regime += kind != last
        expected.append(regime)
        last = kind
    df = typed(spark, kinds)
    got = rows(series.with_regimes(df, ["key"], chunk=chunk), "timestamp", "regime_id")
    assert [r for _, r in got] == expected
    events = series.change_events(df, ["key"], chunk=chunk)
    assert events.count() == regime


def test_regime_summary_weights_rows_across_chunks(spark):
    kinds = ["a"] * 7 + ["b"] * 3
    df = typed(spark, kinds).select(
        F.lit("Period1").alias("period"), F.lit(2).alias("box_id"), F.lit(1).alias("wall_id"),
        "timestamp", "wall_type", "a_surface",
    )
    df = df.union(df.withColumn("box_id", F.lit(1)))
    got = rows(
        series.regime_summary(df, chunk="30 minutes"),
        "regime_id", "wall_type", "timestamp_min", "timestamp_max", "timestamp_count",
        "a_surface_mean",
    )
    assert got == [(1, "a", at(0), at(60), 7, 3.0), (2, "b", at(70), at(90), 3, 8.0)]


def test_regenerated_times_follow_file_order(spark):
    df = spark.createDataFrame(
        [("f", i, float(i)) for i in range(250)] + [("g", 1000, 0.0)],
        "file string, file_order bigint, v double",
    )
    out = series.regenerate_timestamps(
        df, ["file"], ["file_order"], floor_to(F.col("file_order"), 16)
    )
    got = rows(out.where("file = 'f'"), "file_order", "row_index", "timestamp")
    first = datetime(2025, 12, 3, 11, 11)
    assert [i for _, i, _ in got] == list(range(250))
    assert got[0][2] == first and got[7][2] == datetime(2025, 12, 3, 12, 21)
    assert rows(out.where("file = 'g'"), "row_index", "timestamp") == [(0, first)]


def brute_lag(out, inside, max_lag=72):
    """Straight from the definition, with NumPy."""
    pairs = [(o, i) for o, i in zip(out, inside) if o is not None and i is not None]
    if len(pairs) < 10:
        return None, None
    o, i = (np.array(c) for c in zip(*pairs))
    zo = (o - o.mean()) / (o.std() + 1e-8)
    zi = (i - i.mean()) / (i.std() + 1e-8)
    scores = [float(zo[: len(o) - k] @ zi[k:]) for k in range(min(max_lag, len(o) - 1) + 1)]
    k = int(np.argmax(scores))
    a, b = o[: len(o) - k], i[k:]
    if len(a) == 1:
        return 10 * k, scores[k] / len(o)
    a, b = a - a.mean(), b - b.mean()
    return 10 * k, float((a * b).sum() / (np.sqrt((a * a).sum() * (b * b).sum()) + 1e-8))


def lag_frame(spark, groups):
    data = [
        (g, at(10 * n), o, i)
        for g, (out, inside) in groups.items()
        for n, (o, i) in enumerate(zip(out, inside))
    ]
    return spark.createDataFrame(
        data, "g string, timestamp timestamp_ntz, out_surface double, in_surface double"
    )


@pytest.mark.parametrize("block", [80, 4096])
def test_lag_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lag_module, "_BLOCK", block)
    monkeypatch.setattr(lag_module, "_CHUNK", 3_600_000_000)
    rng = random.Random(11)
    wave = [float(20 + 10 * np.sin(n / 9) + rng.random()) for n in range(400)]
    shifted = [None] * 7 + [0.8 * v + 1 for v in wave[:-7]]
    noisy = [v + rng.random() if rng.random() > 0.1 else None for v in wave]
    groups = {
        "shifted": (wave, shifted),
        "noisy": (noisy, wave),
        "random": ([rng.random() for _ in range(150)], [rng.random() for _ in range(150)]),
        "short": (wave[:9], wave[:9]),
        "ten": (wave[:10], [rng.random() for _ in range(10)]),
        "constant": ([5.0] * 40, wave[:40]),
        "empty": ([None] * 20, wave[:20]),
    }
    frame = lag_frame(spark, groups)
    got = {r["g"]: (r["lag_minutes"], r["r"]) for r in thermal_lag(frame, ["g"]).collect()}
    assert set(got) == set(groups)
    for g, (out, inside) in groups.items():
        minutes, r = brute_lag(out, inside)
        assert got[g][0] == minutes, g
        assert (got[g][1] is None) == (r is None)
        if r is not None:
            assert got[g][1] == pytest.approx(r, abs=1e-9), g
    assert got["constant"] == (0, 0.0)
    assert got["short"] == (None, None)


def test_lag_of_a_shifted_series_is_the_shift(spark):
    rng = random.Random(5)
    wave = [rng.random() for _ in range(300)]
    frame = lag_frame(spark, {"k": (wave, [9.0] * 7 + [0.8 * v + 1 for v in wave[:-7]])})
    (row,) = thermal_lag(frame, ["g"]).collect()
    assert row["lag_minutes"] == 70 and row["r"] == pytest.approx(1.0)



def test_any_positive_window_smooths(spark):
    from thermaline.functions.timebins import duration_micros

    df = spark.createDataFrame(
        [(1, datetime(2025, 1, 1, 0, m), float(m)) for m in range(0, 60, 10)] + [(1, None, 5.0)],
        "k int, timestamp timestamp_ntz, x double",
    )
    got = {r.timestamp: r.x_smooth for r in series.smooth(df, ["x"], "30min", ["k"]).collect()}
    assert len(got) == 7 and got[None] is None
    assert got[datetime(2025, 1, 1, 0, 50)] == 40.0
    assert duration_micros("1h30min") == 5_400_000_000 and duration_micros("2 D") == 172_800_000_000
    for wrong in ("", "soon", "0h", "3", "3 parsecs"):
        with pytest.raises(ValueError):
            duration_micros(wrong)


def test_rows_without_a_time_keep_a_regime(spark):
    df = spark.createDataFrame(
        [(1, None, "a"), (1, datetime(2025, 1, 1), "a"), (1, datetime(2025, 1, 2), "b")],
        "k int, timestamp timestamp_ntz, wall_type string",
    )
    got = {r.timestamp: r.regime_id for r in series.with_regimes(df, ["k"]).collect()}
    assert got == {None: 1, datetime(2025, 1, 1): 1, datetime(2025, 1, 2): 2}
