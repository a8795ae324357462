"""Logger text files: preamble, fuzzy header, mixed encodings, cut-off tails.

Three written tables carry the ingest, so that nothing is parsed twice and any executor may be lost:

* lines  - every line with its file, block start and row id, which together give the file order;
* headers - one small row per file: encoding, header cells and where the wanted columns are;
* rows - the wanted cells of every data row, typed, with the number of missing ones.

A file may be of any size: it is read in splits, and per-file facts come from aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thermaline.functions.columns import clean_wall_type, to_number
from thermaline.functions.timebins import parse_any_time, parse_logger_time
from thermaline.operators.levels import with_topology
from thermaline.schema import MEASURES, READINGS_SCHEMA
from thermaline.sources.listing import listed_files
from thermaline.staging import stage

# Header position, file name pattern, period folders, texts that mean "missing".
HEADER_LINE = 15
NAME_PATTERN = r"GW_?(\d+)\.(\d+)_"
PERIOD_PATTERN = r"/(Period\d+)/[^/]+$"
PERIOD_OF_FOLDER_PATTERN = r"/(?:[a-z_]+=)?(Period\d+)/[^/]+/[^/]+$"
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Words a header cell must contain, in the order the kinds are tried.
LOAD_COLUMNS = {
    "date": ["date", "time"],
    "surface": ["value", "heat", "surface"],
    "internal": ["internal", "temp"],
    "room": ["out", "air", "temp"],
    "type": ["wall", "type"],
}
AUDIT_COLUMNS = {
    "surface": ["surface", "heat"],
    "internal": ["internal", "temp"],
    "room": ["air", "temp"],
    "type": ["wall", "type"],
}

# How a file is read: for analysis, for the audits, or for sorting files into periods.
LOAD, AUDIT, CURATE = "load", "audit", "curate"

_QUOTED_COMMA = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'
_FILE = ["path"]


@dataclass
class LoggerFiles:
    """Readings of all good files, the status of every file, and the raw lines (path, block, line_id, raw)."""

    readings: DataFrame
    files: DataFrame
    lines: DataFrame


def parse_name(name: Column) -> tuple[Column, Column]:
    """S6 + S7: box and sensor from a file name; NULLs when it does not fit."""
    box = F.regexp_extract(name, NAME_PATTERN, 1).try_cast("int")
    sensor = F.regexp_extract(name, NAME_PATTERN, 2).try_cast("int")
    return box, sensor


def _after(block: str, line_id: str) -> Column:
    """The row lies behind the place (block, line id) in its file."""
    return (F.col("block") > F.col(block)) | (
        (F.col("block") == F.col(block)) & (F.col("line_id") > F.col(line_id))
    )


def split_cells(line: Column) -> Column:
    """Cells of a CSV line; quotes are honoured where the line has any."""
    quoted = F.transform(
        F.split(line, _QUOTED_COMMA, -1),
        lambda cell: F.replace(
            F.regexp_replace(cell, '^\\s*"|"\\s*$', ""), F.lit('""'), F.lit('"')
        ),
    )
    return F.when(F.contains(line, F.lit('"')), quoted).otherwise(F.split(line, ",", -1))


def _known(cell: Column) -> Column:
    return F.when(~cell.isin(*MISSING_TEXTS), cell)


def _decoded(name: Column) -> Column:
    """A name without the escapes of paths; a plus sign stands for itself there."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def _name_of(path: Column, folders: bool) -> Column:
    """The real file name: paths escape it once, folders that bear a name once more."""
    name = _decoded(F.element_at(F.split(path, "/"), -2 if folders else -1))
    return _decoded(F.regexp_replace(name, "^[a-z_]+=", "")) if folders else name


def _period_of(path: Column, folders: bool) -> Column:
    """The period folder a file lies in directly, NULL when it lies elsewhere."""
    pattern = PERIOD_OF_FOLDER_PATTERN if folders else PERIOD_PATTERN
    return F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))


def list_files(spark: SparkSession, base: str, glob: str, folders: bool = False) -> DataFrame:
    """S1 + S2: every file in a period folder with its name, box and sensor; content unread.

    The folder is listed by tasks (:mod:`thermaline.sources.listing`), files of zero length included, which a scan
    itself skips.
    """
    found = listed_files(spark, base, glob)
    name = _name_of(F.col("path"), folders)
    box, sensor = parse_name(F.col("file"))
    return (
        found.select("path")
        .withColumn("file", name)
        .withColumn("period", _period_of(F.col("path"), folders))
        .where(F.col("period").isNotNull())
        .withColumns({"box_id": box, "sensor_id": sensor})
    )


def read_lines(spark: SparkSession, base: str, glob: str, folders: bool = False) -> DataFrame:
    """S3: the written lines table of the period folders. Row ids are fixed by writing them once."""
    raw = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(base)
    )
    lines = raw.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_id"),
        F.col("value").cast("binary").alias("raw"),
    )
    return stage(lines.where(_period_of(F.col("path"), folders).isNotNull()), "lines")


def _text(raw: Column, latin1: Column) -> Column:
    """One encoding per file - UTF-8, or Latin-1 where any line is not valid UTF-8."""
    return F.when(latin1, F.decode(raw, "ISO-8859-1")).otherwise(raw.cast("string"))


def _not_blank(raw: str) -> Column:
    return F.trim(F.col(raw).cast("string")) != ""


def _last_place(kinds: Column, kind: str) -> Column:
    """0-based place of the last header cell of a kind, NULL when there is none."""
    from_end = F.array_position(F.reverse(kinds), kind).cast("int")
    return F.when(from_end > 0, F.size(kinds) - from_end)


def _first_place(kinds: Column, kind: str) -> Column:
    place = F.array_position(kinds, kind).cast("int")
    return F.when(place > 0, place - 1)


def read_headers(lines: DataFrame, mode: str = LOAD) -> DataFrame:
    """S4 + S5: encoding, header position and wanted columns of each file, as a written table.

    Only the first lines of a file are numbered, and only as many of them as make a header leave a
    task. They lie in the first block but for files read in very small splits; the counts per block
    name the further blocks then, and these are few enough to be looked up.
    """
    filled = lines.where(_not_blank("raw"))
    blocks = stage(
        lines.groupBy(*_FILE, "block").agg(
            F.count_if(_not_blank("raw")).alias("n"),
            F.bool_or(~F.is_valid_utf8(F.col("raw").cast("string"))).alias("latin1"),
        ),
        "blocks",
    )
    before = (
        Window.partitionBy(*_FILE).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    )
    further = stage(
        blocks.withColumn("earlier", F.sum("n").over(before))
        .where((F.col("block") > 0) & (F.col("earlier") < HEADER_LINE))
        .select(*_FILE, "block"),
        "further-blocks",
    )
    leading = filled.where(F.col("block") == 0)
    if not further.isEmpty():
        leading = leading.unionByName(
            filled.where(F.col("block") > 0).join(further, [*_FILE, "block"], "left_semi")
        )
    in_file = Window.partitionBy(*_FILE).orderBy("block", "line_id")
    header_lines = (
        leading.withColumn("n", F.row_number().over(in_file))
        .where(F.col("n") == HEADER_LINE)
        .select(
            *_FILE,
            F.col("block").alias("header_block"),
            F.col("line_id").alias("header_id"),
            F.col("raw").alias("header"),
        )
    )
    encodings = blocks.groupBy(*_FILE).agg(F.bool_or("latin1").alias("latin1"))
    cells = F.transform(
        split_cells(_text(F.col("header"), F.col("latin1"))), lambda c: F.lower(F.trim(c))
    )
    wanted = AUDIT_COLUMNS if mode == AUDIT else LOAD_COLUMNS

    def kind_of(cell: Column) -> Column:
        kind = F.lit("other")
        for name, words in reversed(wanted.items()):
            has_all = F.lit(True)
            for word in words:
                has_all = has_all & F.contains(cell, F.lit(word))
            kind = F.when(has_all, F.lit(name)).otherwise(kind)
        return kind

    placed = (
        header_lines.join(encodings, _FILE)
        .withColumn("kinds", F.transform(cells, kind_of))
        .withColumns({f"{k}_at": _last_place(F.col("kinds"), k) for k in LOAD_COLUMNS})
        .withColumn("width", F.size("kinds"))
    )
    if mode == AUDIT:
        placed = placed.withColumn("date_at", F.lit(0))
    elif mode == CURATE:
        placed = placed.withColumn("date_at", _first_place(F.col("kinds"), "date"))
    return stage(placed.drop("header", "kinds"), "headers")


def read_rows(lines: DataFrame, headers: DataFrame, mode: str = LOAD) -> DataFrame:
    """The data rows under standard names and types, as a written table.

    ``n_missing`` counts the missing texts among date and measures (audit: all columns of the row);
    ``too_wide`` marks rows with more cells than the header.
    """
    split = (
        lines.where(_not_blank("raw"))
        .join(headers, _FILE)
        .where(_after("header_block", "header_id"))
        .withColumn("line", _text(F.col("raw"), F.col("latin1")))
        .withColumn("cells", split_cells(F.col("line")))
    )
    texts = split.withColumns(
        {k: _known(F.get(F.col("cells"), F.col(f"{k}_at"))) for k in LOAD_COLUMNS}
    )
    if mode == AUDIT:
        known = F.size(F.filter("cells", lambda c: ~c.isin(*MISSING_TEXTS)))
        n_missing = F.col("width") - known
    else:
        n_missing = sum(
            (
                (F.col(f"{k}_at").isNotNull() & F.col(k).isNull()).cast("int")
                for k in ("date", "surface", "internal", "room")
            ),
            F.lit(0),
        )
    parse = parse_any_time if mode == AUDIT else parse_logger_time
    return stage(
        texts.select(
            *_FILE,
            "block",
            "line_id",
            parse(F.col("date")).alias("timestamp"),
            *[to_number(F.col(m.removesuffix("_temp"))).alias(m) for m in MEASURES],
            clean_wall_type(F.col("type")).alias("wall_type"),
            n_missing.alias("n_missing"),
            (F.size("cells") > F.col("width")).alias("too_wide"),
        ),
        "rows",
    )


def cut_tails(rows: DataFrame, file: Sequence[str] = tuple(_FILE)) -> DataFrame:
    """Drop each file from its first row with two or more missing values on.

    No cut when that row is the first data row. ``file`` names the columns that tell files apart. First rows are found per block with plain numbers,
    then per file; the cut points are a written table of one row per file that is cut.
    """
    bad = F.when(F.col("n_missing") >= 2, F.col("line_id"))
    per_block = rows.groupBy(*file, "block").agg(
        F.min("line_id").alias("first_id"), F.min(bad).alias("bad_id")
    )
    bad_place = F.when(F.col("bad_id").isNotNull(), F.struct("block", F.col("bad_id").alias("id")))
    cuts = stage(
        per_block.groupBy(*file)
        .agg(
            F.min(F.struct("block", F.col("first_id").alias("id"))).alias("first"),
            F.min(bad_place).alias("bad"),
        )
        .where(F.col("bad") > F.col("first"))
        .select(*file, F.col("bad.block").alias("cut_block"), F.col("bad.id").alias("cut_id")),
        "cuts",
    )
    before_cut = (F.col("block") < F.col("cut_block")) | (
        (F.col("block") == F.col("cut_block")) & (F.col("line_id") < F.col("cut_id"))
    )
    return (
        rows.join(cuts, list(file), "left")
        .where(F.col("cut_id").isNull() | before_cut)
        .drop("cut_block", "cut_id")
    )


def _file_status(
    files: DataFrame, headers: DataFrame, every_row: DataFrame, rows: DataFrame, mode: str
) -> DataFrame:
    """K3 + A20 base: every file with its number of rows and, where it failed, the reason.

    The audits take a file without any readable time as it is and count all its rows.
    """
    wide = every_row.where("too_wide").select(*_FILE).distinct().withColumn("ragged", F.lit(True))
    counted = F.lit(1) if mode == AUDIT else F.col("timestamp")
    loaded = rows.groupBy(*_FILE).agg(F.count(counted).alias("valid_rows"))
    found = (
        files.join(headers.select(*_FILE, "date_at", "width"), _FILE, "left")
        .join(wide, _FILE, "left")
        .join(loaded, _FILE, "left")
    )
    unnamed = F.col("box_id").isNull() | F.col("sensor_id").isNull()
    reason = (
        F.when(unnamed & F.lit(mode == LOAD), "unparsable name")
        .when(F.col("width").isNull(), "no header")
        .when(F.col("ragged"), "ragged row")
        .when(F.col("date_at").isNull(), "no date column")
        .when(F.lit(mode != AUDIT) & (F.coalesce("valid_rows", F.lit(0)) == 0), "no valid time")
    )
    failed = F.col("reason").isNotNull()
    return (
        found.withColumn("reason", reason)
        .withColumn("rows", F.when(failed, F.lit(0)).otherwise(F.coalesce("valid_rows", F.lit(0))))
        .select("path", "period", "file", "box_id", "sensor_id", "reason", "rows")
    )


def load_logger_files(
    spark: SparkSession, base: str, glob: str = "*.csv", folders: bool = False, mode: str = LOAD
) -> LoggerFiles:
    """Readings of every good file in the period folders below ``base``.

    ``folders`` takes the file name from the enclosing folder (files written by Spark). ``mode``:

    * ``load`` - for analysis: tails are cut, rows without a time dropped, names must parse;
    * ``audit`` - the first column is the time in any known format, missing values count over all
      columns, rows without a time stay;
    * ``curate`` - for sorting into periods: tails stay (rows keep ``n_missing``), names need not parse, the first
      date column counts.
    """
    lines = read_lines(spark, base, glob, folders)
    headers = read_headers(lines, mode)
    every_row = read_rows(lines, headers, mode)
    rows = every_row if mode == CURATE else cut_tails(every_row)
    rows = rows.drop("too_wide") if mode == CURATE else rows.drop("n_missing", "too_wide")
    if mode != AUDIT:
        rows = rows.where(F.col("timestamp").isNotNull())
    listing = list_files(spark, base, glob, folders)
    status = stage(_file_status(listing, headers, every_row, rows, mode), "files")
    good = status.where(F.col("reason").isNull()).select(
        "path", "period", "file", "box_id", "sensor_id"
    )
    return LoggerFiles(with_topology(rows.join(good, _FILE)), status, lines)


def readings_only(loaded: LoggerFiles) -> DataFrame:
    """The fixed readings schema, without file order."""
    return loaded.readings.select(*READINGS_SCHEMA.fieldNames())


def load_summary(files: DataFrame) -> DataFrame:
    """Files found, loaded and failed, and rows, per period."""
    return files.groupBy("period").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(F.col("reason").isNull()).alias("n_loaded"),
        F.count_if(F.col("reason").isNotNull()).alias("n_failed"),
        F.sum("rows").alias("rows"),
    )
