from __future__ import annotations

import random

from frames import at, rows

from thermaline.operators import nearest


def frame(spark, data):
    return spark.createDataFrame(
        [("p", f, at(m), float(v), i) for i, (f, m, v) in enumerate(data)],
        "period string, file string, timestamp timestamp_ntz, room_temp double, file_order bigint",
    )


def probes(spark, minutes):
    return spark.createDataFrame(
        [("p", at(m)) for m in minutes], "period string, probe_time timestamp_ntz"
    )


def run(spark, readings, minutes, tolerance=5):
    return nearest.nearest_in_time(
        probes(spark, minutes), readings, ["period"], ["file"], ["room_temp"], tolerance,
        ["file_order"],
    )


def test_nearest_within_tolerance(spark):
    df = frame(
        spark,
        [("near", 716, 1), ("near", 723, 2), ("far", 714, 3), ("far", 726, 4), ("edge", 725, 5),
         ("tie", 718, 6), ("tie", 722, 7)],
    )
    got = rows(run(spark, df, [720]), "file", "match_time", "room_temp", "has_data")
    assert got == [
        ("edge", at(725), 5.0, True),
        ("far", None, None, False),
        ("near", at(723), 2.0, True),
        ("tie", at(718), 6.0, True),
    ]


def test_nearest_equals_brute_force(spark):
    rng = random.Random(2)
    data = [(rng.choice("abc"), rng.uniform(0, 3000), n) for n in range(600)]
    data = [(f, round(m, 3), v) for f, m, v in data]
    targets = [round(rng.uniform(0, 3000), 3) for _ in range(60)]
    got = {
        (r["file"], r["probe_time"]): r["match_time"]
        for r in run(spark, frame(spark, data), targets, 7).collect()
    }
    assert len(got) == 180
    for f in "abc":
        for p in targets:
            near = [(abs(at(m) - at(p)), at(m)) for g, m, _ in data if g == f]
            gap, when = min(near)
            expected = when if gap.total_seconds() <= 420 else None
            assert got[f, at(p)] == expected


def test_noon_probes_and_extremes(spark):
    df = frame(spark, [("a", 700, 1), ("b", 740, 2), ("a", 1440 + 10, 9), ("b", 1440 + 719, 4)])
    noon = nearest.noon_probes(df, ["period"])
    assert rows(noon, "probe_time") == [(at(700),), (at(1440 + 719),)]
    assert nearest.first_days(noon, 1).collect()[0]["probe_time"] == at(700)
    matches = frame(spark, [("b", 0, 5), ("a", 0, 5), ("c", 0, 1)]).withColumnRenamed(
        "timestamp", "probe_time"
    )
    flags = rows(nearest.flag_extremes(matches, ["period"], "file"), "file", "is_max", "is_min")
    assert flags == [("a", True, False), ("b", False, False), ("c", False, True)]
