"""What the plans of heavy operators may cost."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from thermaline.operators import audit, series
from thermaline.plans import flows
from thermaline.sources.events import readings_from_events

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables absent")


def scans(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Scan parquet")


@pytest.fixture(scope="module")
def levels(spark):
    return flows.build_levels(readings_from_events(spark, SF_DIR), "6 hours")


def test_the_overview_reads_the_readings_once(levels):
    assert scans(audit.overview(levels.sensor)) == 1


def test_regimes_are_found_without_building_the_walls_again(levels):
    keys = ["period", "box_id", "wall_id"]
    regimes = series.with_regimes(levels.wall.select(*keys, "timestamp", "wall_type"), keys)
    assert "events.parquet" not in regimes._jdf.queryExecution().executedPlan().toString()


def test_a_saved_level_has_a_file_per_bucket_and_period(spark, levels):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        saved = flows.save_sensor_level(levels.sensor.repartition(8), "saved_sensor_level", 4)
        files = saved.select(F.input_file_name().alias("f")).distinct().count()
        assert files <= 4 * 2
        assert saved.count() == levels.sensor.count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.sql("DROP TABLE IF EXISTS saved_sensor_level")
