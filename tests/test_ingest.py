"""Logger files with every blemish the ingest has to stand."""

from __future__ import annotations

import os
from datetime import datetime

import pytest
from frames import rows

from thermaline.operators import audit
from thermaline.plans.flows import curate_folder, load_curated, load_levels
from thermaline.sources import logger_files as lf
from thermaline.sources.sinks import read_curated
from thermaline.staging import staging_dir

HEADER = "Date/Time,Value Heat Surface Sensor,Internal temp sensor,Out Air temp,Wall Type"
PREAMBLE = [f"preamble {n}" for n in range(14)]


def write(base, period, name, body, header=HEADER, preamble=PREAMBLE, encoding="utf-8"):
    folder = base / period
    folder.mkdir(exist_ok=True)
    text = "\n".join([*preamble, header, *body]) + "\n"
    (folder / name).write_bytes(text.encode(encoding))


def clean(n, day=23, month=10):
    return [f"{month}/{day}/2025 0:{i:02d},1{i}.5,20.0,15.25,Exposed" for i in range(n)]


@pytest.fixture(scope="module")
def base(tmp_path_factory):
    base = tmp_path_factory.mktemp("drop")
    p1 = "Period1"
    write(base, p1, "GW_1.1_111025.csv", clean(20))
    write(base, p1, "GW_1.2_111025.csv", clean(3), preamble=[*PREAMBLE[:5], "", "  ", *PREAMBLE[5:]])
    write(base, p1, "GW_1.3_111025.csv", clean(3), encoding="latin-1",
          header=HEADER.replace("sensor,", "sensor (°C),"))
    body = clean(6)
    body[3] = "10/23/2025 0:03,,NaN,15.0,Exposed"
    write(base, p1, "GW_1.4_111025.csv", body)
    body = clean(4)
    body[0] = "10/23/2025 0:00,,,15.0,Exposed"
    write(base, p1, "GW_1.5_111025.csv", body)
    body = clean(4)
    body[1] = "10/23/2025 0:01,N/A,20.0,15.0,Exposed"
    write(base, p1, "GW_1.6_111025.csv", body)
    body = clean(4)
    body[2] = "10/23/2025 0:02:30,1.0,2.0,3.0,Exposed"
    write(base, p1, "GW_1.7_111025.csv", body)
    write(base, p1, "GW_1.8_111025.csv", ["10/23/2025 0:00,1.0,2.0,3.0, Yraka "])
    body = clean(3)
    body[1] = "10/23/2025 0:01,error,20.0,15.0,Exposed"
    write(base, p1, "GW_1.9_111025.csv", body)
    write(base, p1, "notes.csv", clean(3))
    write(base, p1, "GW_1.10_111025.csv", clean(3), header=HEADER.replace("Date/Time", "When"))
    write(base, p1, "GW_1.11_111025.csv",
          ['10/23/2025 0:00,1.0,2.0,3.0,Yarka,"dry, hot ""x"""'], header=HEADER + ",Note")
    write(base, p1, "GW_1.12_111025.csv", [r.rsplit(",", 1)[0] for r in clean(3)],
          header=HEADER.rsplit(",", 1)[0])
    write(base, p1, "GW_1.13_111025.csv", ["junk,1.0,2.0,3.0,Exposed"] * 3)
    write(base, p1, "GW_1.14_111025.csv", [*clean(2), "10/23/2025 0:02,1,2,3,Exposed,extra"])
    (base / p1 / "GW_1.15_111025.csv").write_text("only\nthree\nlines\n")
    (base / p1 / "GW_1.16_111025.csv").write_text("")
    write(base, "Period2", "GW2.17_121125.csv", clean(5, 13, 12))
    (base / p1 / "readme.txt").write_text("not a logger file")
    write(base, "Excluded", "Period1_GW_1.1_111025.csv", clean(3))
    write(base, "Period1/old", "GW_1.1_111025.csv", clean(3))
    return base


@pytest.fixture(scope="module")
def loaded(spark, base):
    return lf.load_logger_files(spark, str(base))


def of(loaded, sensor):
    columns = ["timestamp", "surface_temp", "internal_temp", "room_temp", "wall_type"]
    return rows(loaded.readings.where(f"sensor_id = {sensor}"), *columns)


def minute(m):
    return datetime(2025, 10, 23, 0, m)


def test_names_with_blanks_and_signs(spark, tmp_path):
    names = ["GW1.2_b c.csv", "GW1.3_50%25.csv", "GW1.4_a+b.csv", "GW_1.5_ü#1.csv"]
    folder = tmp_path / "Period1"
    folder.mkdir()
    for name in names:
        lines = [f"# {i}" for i in range(14)] + ["Date/Time,Out Air temp", "11/1/2025 10:00,20.5"]
        (folder / name).write_text("\n".join(lines), encoding="utf-8")
    loaded = lf.load_logger_files(spark, str(tmp_path))
    assert {r["file"] for r in loaded.files.collect()} == set(names)
    assert rows(loaded.readings, "file", "sensor_id") == sorted(zip(names, [2, 3, 4, 5]))


def test_statuses(loaded):
    reasons = {r["file"]: r["reason"] for r in loaded.files.collect()}
    assert len(reasons) == 18
    failed = {name: reason for name, reason in reasons.items() if reason}
    assert failed == {
        "notes.csv": "unparsable name",
        "GW_1.10_111025.csv": "no date column",
        "GW_1.13_111025.csv": "no valid time",
        "GW_1.14_111025.csv": "ragged row",
        "GW_1.15_111025.csv": "no header",
        "GW_1.16_111025.csv": "no header",
    }


def test_load_summary(loaded):
    got = rows(lf.load_summary(loaded.files), "period", "n_files", "n_loaded", "n_failed", "rows")
    assert got == [("Period1", 17, 11, 6, 48), ("Period2", 1, 1, 0, 5)]


def test_clean_blank_lines_and_latin1(loaded):
    assert len(of(loaded, 1)) == 20
    assert of(loaded, 1)[0] == (minute(0), 10.5, 20.0, 15.25, "Exposed")
    assert len(of(loaded, 2)) == 3
    assert [r[2] for r in of(loaded, 3)] == [20.0] * 3


def test_tail_cut(loaded):
    assert [r[0] for r in of(loaded, 4)] == [minute(0), minute(1), minute(2)]
    first = of(loaded, 5)
    assert len(first) == 4 and first[0][1:4] == (None, None, 15.0)
    assert of(loaded, 6)[1] == (minute(1), None, 20.0, 15.0, "Exposed")


def test_cells(loaded):
    assert [r[0] for r in of(loaded, 7)] == [minute(0), minute(1), minute(3)]
    assert of(loaded, 8)[0][4] == "Yarka"
    assert of(loaded, 9)[1][1] is None and of(loaded, 9)[1][2] == 20.0
    assert of(loaded, 11) == [(minute(0), 1.0, 2.0, 3.0, "Yarka")]
    assert [r[4] for r in of(loaded, 12)] == [None] * 3


def test_identity_and_schema(loaded):
    got = rows(
        loaded.readings.where("sensor_id in (9, 17)").select(
            "period", "box_id", "sensor_id", "wall_id", "position"
        ).distinct(),
        "period", "box_id", "sensor_id", "wall_id", "position",
    )
    assert got == [("Period1", 1, 9, 1, "in"), ("Period2", 2, 17, None, None)]
    assert dict(lf.readings_only(loaded).dtypes)["timestamp"] == "timestamp_ntz"


def test_split_files_read_the_same(spark, base, loaded):
    """File order holds when one file is read in many splits."""
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    open_cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        lines = lf.read_lines(spark, str(base), "*.csv")
        assert lines.where("path like '%GW_1.1_%'").select("block").distinct().count() > 3
        split = lf.load_logger_files(spark, str(base))
        columns = ["file", "timestamp", "surface_temp", "internal_temp", "room_temp", "wall_type"]
        assert rows(split.readings, *columns) == rows(loaded.readings, *columns)
        assert rows(split.files, "file", "reason") == rows(loaded.files, "file", "reason")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", open_cost)


def test_audit_reading(spark, tmp_path):
    header = HEADER.replace("Date/Time", "When") + ",Note"
    body = [
        "2025-10-23 00:00:00,1,2,3,a,n",
        "10/23/2025 0:01,1,2,3,a,",
        "soon,1,2,3,a,n",
        "10/23/2025 0:03,1,2,3,,",
        "10/23/2025 0:04,1,2,3,a,n",
    ]
    write(tmp_path, "Period1", "GW_1.1_111025.csv", body, header=header)
    write(tmp_path, "Period1", "GW_1.2_111025.csv", [",,2,3,a,n", *body[:2]], header=header)
    got = lf.load_logger_files(spark, str(tmp_path), mode=lf.AUDIT)
    times = rows(got.readings.where("sensor_id = 1"), "timestamp")
    assert times == [(minute(0),), (minute(1),), (None,)]
    assert got.readings.where("sensor_id = 2").count() == 3
    profile = {r["file"]: r for r in audit.file_profile(got.readings).collect()}
    assert profile["GW_1.1_111025.csv"]["rows"] == 3
    assert profile["GW_1.1_111025.csv"]["min_time"] == minute(0)
    assert profile["GW_1.2_111025.csv"]["has_nulls"] is True


def test_uncut_rows_for_curation(spark, base):
    uncut = lf.load_logger_files(spark, str(base), mode=lf.CURATE)
    assert uncut.readings.where("sensor_id = 4").count() == 6
    assert uncut.readings.where("file = 'notes.csv'").count() == 3


def test_folders_to_levels_and_to_curated_periods(spark, base, tmp_path):
    levels = load_levels(spark, str(base))
    assert levels.box.count() == 3
    totals = {r["status"]: (r["n_files"], r["rows"])
              for r in curate_folder(spark, str(base), str(tmp_path)).collect()}
    assert totals == {"Period1": (12, 54), "excluded": (6, 5)}
    assert read_curated(spark, str(tmp_path)).count() == 54
    out = spark.read.parquet(f"{tmp_path}/quarantine")
    assert rows(out.groupBy("file", "reason").count(), "file", "reason", "count") == [
        ("Period1_GW_1.10_111025.csv", "no date column", 18),
        ("Period1_GW_1.13_111025.csv", "no valid time", 18),
        ("Period1_GW_1.14_111025.csv", "ragged row", 18),
        ("Period1_GW_1.15_111025.csv", "no header", 3),
        ("Period2_GW2.17_121125.csv", "no rows in period range", 20),
    ]
    raw = out.where("file like '%1.15%'").orderBy("block", "line_id").select("raw").collect()
    assert [bytes(r.raw) for r in raw] == [b"only", b"three", b"lines"]
    verdicts = spark.read.parquet(f"{tmp_path}/verdicts")
    assert verdicts.count() == 18 and verdicts.where("status = 'excluded'").count() == 6


def test_a_second_run_leaves_nothing_of_the_first(spark, base, tmp_path):
    target = str(tmp_path / "target")
    curate_folder(spark, str(base), target)
    small = tmp_path / "small"
    small.mkdir()
    write(small, "Period2", "GW2.1_121125.csv", clean(3, 4, 12))
    curate_folder(spark, str(small), target)
    again = read_curated(spark, target)
    assert rows(again.select("period").distinct(), "period") == [("Period2",)]
    assert spark.read.schema("file string").parquet(f"{target}/quarantine").count() == 0


def test_nothing_staged_is_left_behind(spark, base, tmp_path):
    folder = f"{staging_dir(spark)}/{spark.sparkContext.applicationId}".removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    curate_folder(spark, str(base), str(tmp_path))
    assert set(os.listdir(folder)) <= before


def test_levels_from_curated_data(spark, tmp_path):
    drop, target = tmp_path / "drop", str(tmp_path / "target")
    drop.mkdir()
    body = clean(8, 4, 12)
    body[5] = body[5].replace("15.5", "").replace("20.0", "")
    write(drop, "Period2", "GW2.1_121125.csv", body)
    write(drop, "Period2", "notes.csv", clean(4, 4, 12))
    write(drop, "Period1", "GW1.1_111025.csv", clean(4, 4, 12))
    curate_folder(spark, str(drop), target)
    levels = load_curated(spark, target, "1 minute")
    assert rows(levels.sensor, "box_id", "sensor_id", "timestamp") == [
        (2, 1, datetime(2025, 12, 4, 0, m)) for m in range(5)
    ]


def test_numbers_are_decimal_texts_only(spark, tmp_path):
    texts = ["72.5F", "1d", "0x1p3", "1_0", "--1", "1e2", " 7. ", "-.5", "+3", "Infinity", "nan"]
    body = [f"10/23/2025 0:{i:02d},{text},1,2,Exposed" for i, text in enumerate(texts)]
    write(tmp_path, "Period1", "GW1.1_x.csv", body)
    got = rows(lf.load_logger_files(spark, str(tmp_path)).readings, "timestamp", "surface_temp")
    assert [v for _, v in got] == [None] * 5 + [100.0, 7.0, -0.5, 3.0, float("inf"), None]


def test_last_matching_column_wins(spark, tmp_path):
    header = "Date/Time,Internal temp old,Internal temp new"
    write(tmp_path, "Period1", "GW1.1_x.csv", ["10/23/2025 0:00,1,2"], header=header)
    got = lf.load_logger_files(spark, str(tmp_path))
    assert rows(got.readings, "internal_temp", "surface_temp") == [(2.0, None)]
