"""Folder listings by tasks, against Spark's own scan and the operating system."""

from __future__ import annotations

import os
import re
from fnmatch import fnmatchcase

import pytest
from frames import rows
from pyspark.errors import AnalysisException

from thermaline.sources import logger_files as lf
from thermaline.sources.listing import glob_pattern, listed_files


def scanned(spark, base, glob):
    """Files of a scan, which leaves out empty ones."""
    options = {"recursiveFileLookup": "true", "pathGlobFilter": glob}
    files = spark.read.format("binaryFile").options(**options).load(str(base))
    return {r[0] for r in files.select("_metadata.file_path").collect()}


@pytest.mark.parametrize("levels", [0, 1, 3])
def test_paths_are_those_of_a_scan(spark, tmp_path, levels):
    names = ["plain.csv", "b c.csv", "50%25.csv", "a+b;c=d,e.csv", "ü#?1.csv", "no\u00a0break\u2003.csv", "[x]{y}^`|.csv"]
    folders = ["Period1", "Period2/deep/er/and/deeper", "box=1/a b%", "_hidden", ".also", "_kept=1"]
    for folder in folders:
        (tmp_path / folder).mkdir(parents=True)
        for name in names:
            (tmp_path / folder / name).write_text("x")
        (tmp_path / folder / "empty.csv").write_text("")
        (tmp_path / folder / "_skipped.csv").write_text("x")
        (tmp_path / folder / ".skipped.csv").write_text("x")
        (tmp_path / folder / "other.txt").write_text("x")
    (tmp_path / "Empty").mkdir()
    got = listed_files(spark, str(tmp_path), "*.csv", levels).collect()
    assert len(got) == len({r["path"] for r in got}) == 4 * (len(names) + 1)
    assert {r["path"] for r in got if r["size"]} == scanned(spark, tmp_path, "*.csv")
    assert sum(r["size"] == 0 for r in got) == 4


def test_ten_thousand_files_never_reach_the_driver(spark, tmp_path):
    for period in ("Period1", "Period2"):
        (tmp_path / period).mkdir()
        for i in range(5000):
            (tmp_path / period / f"GW_1.{i}_x.csv").touch()
    files = lf.list_files(spark, str(tmp_path), "*.csv")
    plan = files._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" not in plan and "GW_1" not in plan.replace(lf.NAME_PATTERN, "")
    assert files.count() == 10_000
    assert rows(files.groupBy("period").count(), "period", "count") == [("Period1", 5000), ("Period2", 5000)]
    assert files.where("sensor_id = 4999").count() == 2


def test_empty_and_missing_folders(spark, tmp_path):
    assert listed_files(spark, str(tmp_path)).collect() == []
    with pytest.raises(AnalysisException):
        listed_files(spark, str(tmp_path / "absent"))


def test_globs():
    names = ["a.csv", "ab.csv", "a.CSV", "b.txt", "a-b.csv", "acsv", "x\ny.csv"]
    for glob in ["*", "*.csv", "?.csv", "a[b-]*.csv", "[!a]*", "a*", "a.csv"]:
        java = glob_pattern(glob)
        pattern = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: re.escape(chr(int(m[1], 16))), java[1:-1]))
        assert [n for n in names if pattern.fullmatch(n)] == [n for n in names if fnmatchcase(n, glob)], glob
    assert glob_pattern("{a,b}.c") == r"^(?s:(?:a|b)\x{2e}c)$"


def test_braces_in_a_glob(spark, tmp_path):
    for name in ("a.csv", "b.txt", "c.log"):
        (tmp_path / name).write_text("x")
    got = listed_files(spark, str(tmp_path), "*.{csv,txt}")
    assert sorted(os.path.basename(r["path"]) for r in got.collect()) == ["a.csv", "b.txt"]
