from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from frames import rows
from pyspark.sql import functions as F

from thermaline.operators import curate
from thermaline.sources import logger_files, sinks
from thermaline.staging import stage, staging_path

P1 = datetime(2025, 10, 23)
P2 = datetime(2025, 12, 3, 11)
P2_END = datetime(2025, 12, 11, 11, 59, 59)
HOUR = timedelta(hours=1)


def frame(spark):
    files = {
        ("Period1", "fits"): [P1, P1 + HOUR, datetime(2025, 11, 6, 23, 59, 59), None],
        ("Period1", "late"): [P1, datetime(2025, 11, 7)],
        ("Period1", "blank"): [None, None],
        ("Period2", "inside"): [P2, P2 + HOUR],
        ("Period2", "runs over"): [P2 + HOUR, P2_END, P2_END + HOUR],
        ("Period2", "after"): [P2_END + HOUR],
        ("Period2", "spans"): [P2 - HOUR, P2, P2 + HOUR, P2_END + HOUR],
        ("Period2", "jumps over"): [P2 - HOUR, P2_END + HOUR],
        ("Period2", "is first"): [P1, P1 + HOUR],
        ("Period2", "before"): [P2 - HOUR],
    }
    data = [
        (period, name, i, t)
        for (period, name), times in files.items()
        for i, t in enumerate(times)
    ]
    return spark.createDataFrame(
        data, "source_period string, file string, file_order bigint, timestamp timestamp_ntz"
    )


def test_verdicts(spark):
    failed = spark.createDataFrame(
        [("Period1", "bad", "no date column")], "source_period string, file string, reason string"
    )
    got = rows(
        curate.file_verdicts(frame(spark), failed=failed), "file", "status", "reason", "rows"
    )
    assert got == sorted(
        [
            ("fits", "Period1", None, 3),
            ("late", "excluded", "outside period", 2),
            ("blank", "excluded", "no valid time", 0),
            ("inside", "Period2", None, 2),
            ("runs over", "Period2", None, 2),
            ("after", "excluded", "no rows in period range", 1),
            ("spans", "Period2", None, 2),
            ("jumps over", "excluded", "no rows in period range", 2),
            ("is first", "excluded", "belongs to another period", 2),
            ("before", "excluded", "outside period", 1),
            ("bad", "excluded", "no date column", 0),
        ]
    )


def test_rows_follow_verdicts_and_survive_the_sinks(spark, tmp_path):
    df = frame(spark)
    verdicts = curate.file_verdicts(df)
    judged = curate.judged_rows(df, verdicts)
    kept, out = curate.curated_rows(judged), curate.quarantined_rows(judged)
    valid = df.where("timestamp is not null").count()
    assert kept.count() == 9 and kept.count() + out.count() == valid - 3
    totals = {r["status"]: (r["n_files"], r["rows"])
              for r in curate.curation_totals(verdicts).collect()}
    assert totals == {"Period1": (1, 3), "Period2": (3, 6), "excluded": (6, 8)}
    base = str(tmp_path)
    sinks.write_curated(kept, base)
    sinks.write_curated(kept, base)
    again = sinks.read_curated(spark, base)
    assert again.count() == 9
    plan = again.where("period = 'Period2'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(period" in plan
    path = sinks.write_quarantine(out, base)
    quarantined = spark.read.parquet(path)
    assert rows(quarantined.select("file").distinct(), "file")[0] == ("Period1_late",)


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(P1, 1.5, None)], "timestamp timestamp_ntz, x double, y string")
    path = sinks.export_level(df, str(tmp_path), "Wall", "Period1")
    assert path.endswith("thermal_data_wall_Period1.csv")
    text = {r["value"] for r in spark.read.text(path).collect()}
    assert text == {"timestamp,x,y", "2025-10-23 00:00:00,1.5,"}
    again = spark.read.csv(path, header=True, schema="timestamp timestamp_ntz, x double, y string")
    assert [tuple(r) for r in again.collect()] == [(P1, 1.5, None)]
    with pytest.raises(ValueError, match="No data"):
        sinks.export_level(df.where("x > 2"), str(tmp_path), "Wall")


def test_an_empty_or_failed_export_leaves_the_earlier_one(spark, tmp_path):
    df = spark.range(10).selectExpr("id", "id / 2 as x")
    path = sinks.export_level(df, str(tmp_path), "Box", "Period1")
    with pytest.raises(ValueError, match="No data"):
        sinks.export_level(df.where("id < 0"), str(tmp_path), "Box", "Period1")
    with pytest.raises(Exception):
        sinks.export_level(df.selectExpr("raise_error('lost') as id"), str(tmp_path), "Box", "Period1")
    assert spark.read.csv(path, header=True).count() == 10
    sinks.export_level(df.limit(3), str(tmp_path), "Box", "Period1")
    assert spark.read.csv(path, header=True).count() == 3
    assert [p.name for p in tmp_path.iterdir()] == ["thermal_data_box_Period1.csv"]


def test_repaired_clocks_are_limited_to_named_files(spark):
    df = spark.createDataFrame(
        [("GW2.1_121125.csv", 0), ("GW2.1_121125.csv", 1), ("GW2.2_121125.csv", 0)],
        "file string, file_order bigint",
    )
    got = curate.repair_clocks(df, ["file_order"], F.lit(0).cast("bigint"))
    texts = rows(sinks.with_logger_text(got), "file", "date_text")
    assert texts == [("GW2.1_121125.csv", "12/3/2025 11:11"), ("GW2.1_121125.csv", "12/3/2025 11:21")]


def test_logger_text_reads_back(spark, tmp_path):
    data = [
        ("Period2", "GW2.1_a.csv", i, f"12/3/2025 11:{i:02d}", float(i), 1.0, None, "Exposed")
        for i in range(30)
    ]
    df = spark.createDataFrame(
        data,
        "folder string, file string, file_order bigint, date_text string, surface_temp double, "
        "internal_temp double, room_temp double, wall_type string",
    )
    path = sinks.write_logger_text(df.repartition(4), str(tmp_path / "logs"))
    loaded = logger_files.load_logger_files(spark, path, "*.txt", folders=True)
    got = rows(loaded.readings, "timestamp", "surface_temp", "room_temp", "box_id", "sensor_id")
    assert got[3] == (datetime(2025, 12, 3, 11, 3), 3.0, None, 2, 1) and len(got) == 30


def test_stage_keeps_schema_and_uses_the_shared_folder(spark):
    df = spark.range(3).withColumn("t", F.lit("2025-01-01 00:00:00").cast("timestamp_ntz"))
    staged = stage(df, "demo")
    assert staged.dtypes == df.dtypes and staged.count() == 3
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert staging_path(spark, "x").startswith(configured.rstrip("/"))
    assert staging_path(spark, "x") != staging_path(spark, "x")
