"""The registered queries again, in DuckDB SQL on the same tables, written independently."""

from __future__ import annotations

READINGS = """
raw_readings AS (
  SELECT CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 'Period1' ELSE 'Period2' END AS period,
    CAST(event_id % 2 + 1 AS INTEGER) AS box_id,
    CAST((event_id // 2) % 16 + 1 AS INTEGER) AS sensor_id,
    ts, event_id AS file_order, event_type AS label,
    CASE WHEN event_id % 97 <> 0 THEN value END AS internal_temp,
    CASE WHEN event_id % 89 <> 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS surface_temp,
    20.0::DOUBLE + extract(hour FROM ts) / 2.0::DOUBLE AS room_temp
  FROM events),
r AS (
  SELECT *,
    CAST((sensor_id - 1) % 8 // 2 + 1 AS INTEGER) AS wall_id,
    CASE WHEN sensor_id <= 8 THEN 'out' ELSE 'in' END AS pos,
    'GW_' || box_id || '.' || sensor_id || CASE period WHEN 'Period1' THEN '_111025.csv' ELSE '_121125.csv' END AS file,
    CASE WHEN file_order % 83 = 5 THEN NULL
         WHEN box_id = 1 OR extract(day FROM ts) <= 8 THEN 'Exposed'
         WHEN extract(day FROM ts) <= 16 THEN 'Yarka'
         WHEN extract(day FROM ts) <= 24 THEN 'Dry soil' ELSE 'Succalents' END AS wall_type
  FROM raw_readings)"""

EXCLUDED = "(VALUES (1, 3), (2, 9), (2, 10)) AS x(box_id, sensor_id)"

SLICES = """
slices AS (
  SELECT * EXCLUDE (file, slot, early, swapped),
    CASE WHEN early <> swapped THEN 'Period1' ELSE 'Period2' END AS source_period,
    'GW_' || box_id || '.' || sensor_id || '_' || slot || '.csv' AS file
  FROM (SELECT *, least(5, (extract(day FROM ts) - 1) // 5) AS slot,
               least(5, (extract(day FROM ts) - 1) // 5) < 3 AS early,
               box_id = 1 AND sensor_id IN (7, 14) AS swapped FROM r))"""

RANGES = """
ranges AS (
  SELECT * FROM (VALUES
    ('Period1', TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-11 23:59:59'),
    ('Period2', TIMESTAMP '2024-01-18 11:00:00', TIMESTAMP '2024-01-26 11:59:59')) AS t(period, lo, hi))"""


def nine(*columns: str) -> str:
    """Doubles at nine decimals, ties shifted as in the catalog; ``expression AS name`` keeps its name."""
    parts = []
    for column in columns:
        expression, _, name = column.rpartition(" AS ")
        parts.append(f"round({expression or name} + 3.7e-11, 9) + 0.0::DOUBLE AS {name}")
    return ", ".join(parts)


def sensor(width: str) -> str:
    """CTEs down to the sensor level ``s``."""
    return f"""{READINGS},
binned AS (SELECT *, time_bucket(INTERVAL '{width}', ts) AS bin FROM r),
modes AS (
  SELECT period, box_id, sensor_id, bin, wall_type FROM (
    SELECT period, box_id, sensor_id, bin, wall_type,
      row_number() OVER (PARTITION BY period, box_id, sensor_id, bin ORDER BY count(*) DESC, wall_type) AS rn
    FROM binned WHERE wall_type IS NOT NULL GROUP BY period, box_id, sensor_id, bin, wall_type)
  WHERE rn = 1),
means AS (
  SELECT period, box_id, sensor_id, wall_id, pos, bin,
    avg(surface_temp) AS surface_temp, avg(internal_temp) AS internal_temp, avg(room_temp) AS room_temp
  FROM binned GROUP BY ALL),
s AS (
  SELECT m.*, t.wall_type, surface_temp - room_temp AS normalized_surface,
    internal_temp - room_temp AS normalized_internal
  FROM means m LEFT JOIN modes t USING (period, box_id, sensor_id, bin))"""


def levels(width: str = "6 hours", sensors: str = "s") -> str:
    """CTEs down to wall level ``w`` and box level ``b``, from the sensor rows ``sensors``."""
    sides = ", ".join(
        f"max({c}) FILTER (pos = '{p}') AS {p}_{n}"
        for p in ("out", "in")
        for c, n in [
            ("surface_temp", "surface"),
            ("internal_temp", "internal"),
            ("room_temp", "room"),
            ("n", "sensor_count"),
            ("normalized_surface", "normalized_surface"),
            ("normalized_internal", "normalized_internal"),
            ("wall_type", "type"),
        ]
    )
    return f"""{sensor(width)},
chosen AS ({f'SELECT * FROM {sensors}' if ' ' not in sensors else sensors}),
side_modes AS (
  SELECT period, box_id, wall_id, pos, bin, wall_type FROM (
    SELECT period, box_id, wall_id, pos, bin, wall_type,
      row_number() OVER (PARTITION BY period, box_id, wall_id, pos, bin ORDER BY count(*) DESC, wall_type) AS rn
    FROM chosen WHERE wall_type IS NOT NULL GROUP BY period, box_id, wall_id, pos, bin, wall_type)
  WHERE rn = 1),
side_means AS (
  SELECT period, box_id, wall_id, pos, bin, avg(surface_temp) AS surface_temp,
    avg(internal_temp) AS internal_temp, avg(room_temp) AS room_temp, count(*) AS n,
    avg(normalized_surface) AS normalized_surface, avg(normalized_internal) AS normalized_internal
  FROM chosen GROUP BY ALL),
pivoted AS (
  SELECT period, box_id, wall_id, bin, {sides}
  FROM side_means LEFT JOIN side_modes USING (period, box_id, wall_id, pos, bin)
  GROUP BY period, box_id, wall_id, bin),
w AS (
  SELECT * EXCLUDE (in_type, out_type),
    CASE WHEN in_sensor_count IS NOT NULL THEN in_type ELSE out_type END AS wall_type,
    CASE WHEN out_sensor_count IS NOT NULL THEN out_room ELSE in_room END AS room_temp,
    (out_internal + in_internal) / 2 AS internal_avg,
    out_surface - in_surface AS surface_gradient, out_internal - in_internal AS internal_gradient
  FROM pivoted),
b AS (
  SELECT period, box_id, bin, avg(internal_temp) AS internal_temp, avg(room_temp) AS room_temp,
    count(*) AS sensor_count, avg(normalized_internal) AS normalized_internal,
    avg(surface_temp) FILTER (pos = 'in') AS surface_temp,
    avg(normalized_surface) FILTER (pos = 'in') AS normalized_surface
  FROM chosen GROUP BY period, box_id, bin)"""


BOX_COLUMNS = "period, box_id, bin AS timestamp, sensor_count, " + nine(
    "internal_temp", "room_temp", "normalized_internal", "surface_temp", "normalized_surface"
)
WALL_COLUMNS = (
    "period, box_id, wall_id, bin AS timestamp, wall_type, out_sensor_count, in_sensor_count, "
    + nine(
        *[
            f"{p}_{c}"
            for p in ("out", "in")
            for c in (
                "surface",
                "internal",
                "room",
                "normalized_surface",
                "normalized_internal",
            )
        ],
        "room_temp",
        "internal_avg",
        "out_surface - room_temp AS gradient_air_to_out_surface",
        "in_surface - out_surface AS gradient_out_to_in_surface",
        "internal_avg - in_surface AS gradient_in_surface_to_internal",
        "internal_avg - room_temp AS total_gradient",
        "surface_gradient",
        "internal_gradient",
    )
)
SENSOR_COLUMNS = "period, box_id, sensor_id, wall_id, pos AS position, bin AS timestamp, wall_type, "
MEASURES = ["surface_temp", "internal_temp", "room_temp"]
KEPT_SENSORS = f"SELECT s.* FROM s ANTI JOIN {EXCLUDED} USING (box_id, sensor_id)"


def smooth(source: str, keys: str, columns: list[str], window: str) -> str:
    frame = (
        f"OVER (PARTITION BY {keys} ORDER BY bin "
        f"RANGE BETWEEN INTERVAL '{window}' PRECEDING AND CURRENT ROW)"
    )
    shown = nine(*[f"avg({c}) {frame} AS {c}_smooth" for c in columns])
    return f"SELECT {keys}, bin AS timestamp, {shown} FROM {source}"


BELOW_30MIN = "29 minutes 59.999999 seconds"
BELOW_1H = "59 minutes 59.999999 seconds"
BELOW_3H = "2 hours 59 minutes 59.999999 seconds"
BELOW_12H = "11 hours 59 minutes 59.999999 seconds"
BELOW_30D = "29 days 23 hours 59 minutes 59.999999 seconds"
BOX_SMOOTHED = ["internal_temp", "surface_temp", "normalized_internal", "normalized_surface"]
WALL_SMOOTHED = [
    "out_internal", "in_internal", "out_surface", "in_surface", "surface_gradient",
    "internal_gradient",
]

REGIMES = """
flags AS (
  SELECT *, CASE WHEN row_number() OVER o = 1 OR wall_type IS DISTINCT FROM lag(wall_type) OVER o
                 THEN 1 ELSE 0 END AS changed
  FROM w WINDOW o AS (PARTITION BY period, box_id, wall_id ORDER BY bin)),
regimes AS (
  SELECT *, CAST(sum(changed) OVER (PARTITION BY period, box_id, wall_id ORDER BY bin
    ROWS UNBOUNDED PRECEDING) AS BIGINT) AS regime_id FROM flags)"""

LAG = """
series AS (
  SELECT wall_type, bin, avg(out_surface) AS o, avg(in_surface) AS i
  FROM w WHERE box_id = 2 AND wall_type IS NOT NULL GROUP BY wall_type, bin),
pairs AS (
  SELECT wall_type, o, i, row_number() OVER (PARTITION BY wall_type ORDER BY bin) AS p
  FROM series WHERE o IS NOT NULL AND i IS NOT NULL),
stats AS (
  SELECT wall_type, count(*) AS n, avg(o) AS mo, avg(i) AS mi, stddev_pop(o) + 1e-8 AS so, stddev_pop(i) + 1e-8 AS si
  FROM pairs GROUP BY wall_type HAVING count(*) >= 10),
z AS (SELECT wall_type, n, p, o, i, (o - mo) / so AS zo, (i - mi) / si AS zi FROM pairs JOIN stats USING (wall_type)),
scores AS (
  SELECT a.wall_type, k, sum(a.zo * c.zi) AS score FROM z a, range(0, 73) g(k), z c
  WHERE a.wall_type = c.wall_type AND c.p = a.p + k AND k < a.n GROUP BY a.wall_type, k),
best AS (
  SELECT wall_type, k FROM (SELECT wall_type, k, row_number() OVER (PARTITION BY wall_type ORDER BY score DESC, k) AS rn FROM scores)
  WHERE rn = 1),
aligned AS (
  SELECT a.wall_type, b.k, a.n, a.o, c.i, a.zo * c.zi AS zz FROM z a JOIN best b USING (wall_type)
  JOIN z c ON c.wall_type = a.wall_type AND c.p = a.p + b.k),
lagged AS (
  SELECT wall_type, CAST(k * 10 AS INTEGER) AS lag_minutes,
    CASE WHEN count(*) > 1 THEN covar_pop(o, i) * count(*) / (sqrt(var_pop(o) * count(*) * var_pop(i) * count(*)) + 1e-8)
         ELSE sum(zz) / n END AS r
  FROM aligned GROUP BY wall_type, k, n)"""

PROBES = """
nearest_noon AS (
  SELECT period, ts, row_number() OVER (PARTITION BY period, CAST(ts AS DATE)
    ORDER BY abs(epoch_us(ts) - epoch_us(CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 12 HOUR)), ts) AS rn FROM r),
probes AS (SELECT period, ts AS probe_time FROM nearest_noon WHERE rn = 1)"""

MATCHES = f"""{PROBES},
near AS (
  SELECT p.period, p.probe_time, r.file, r.ts, surface_temp, internal_temp, room_temp, wall_type,
    row_number() OVER (PARTITION BY p.period, p.probe_time, r.file
      ORDER BY abs(epoch_us(r.ts) - epoch_us(p.probe_time)), r.ts, file_order) AS rn
  FROM probes p JOIN r ON r.period = p.period
    AND r.ts BETWEEN p.probe_time - INTERVAL 60 MINUTE AND p.probe_time + INTERVAL 60 MINUTE),
grid AS (SELECT period, probe_time, file FROM probes JOIN (SELECT DISTINCT period, file FROM r) USING (period)),
found AS (SELECT g.*, n.* EXCLUDE (period, probe_time, file, rn) FROM grid g
  LEFT JOIN (SELECT * FROM near WHERE rn = 1) n USING (period, probe_time, file)),
ranked AS (SELECT *,
    row_number() OVER (PARTITION BY period, probe_time ORDER BY room_temp DESC NULLS LAST, file) AS hi,
    row_number() OVER (PARTITION BY period, probe_time ORDER BY room_temp NULLS LAST, file) AS lo FROM found)"""

FILES = """
files AS (
  SELECT period, file, box_id, sensor_id, wall_id, pos, count(*) AS rows, min(ts) AS min_time, max(ts) AS max_time,
    count(*) FILTER (surface_temp IS NULL) AS missing_surface_temp,
    count(*) FILTER (internal_temp IS NULL) AS missing_internal_temp,
    count(*) FILTER (room_temp IS NULL) AS missing_room_temp,
    count(*) FILTER (wall_type IS NULL) AS missing_wall_type
  FROM r GROUP BY ALL)"""

CHECKED = [*MEASURES, "wall_type"]
MISSING = [f"missing_{m}" for m in CHECKED]
ALL_MISSING = " + ".join(MISSING)
MISSING_SUMS = ", ".join(f"CAST(sum({m}) AS BIGINT) AS {m}" for m in MISSING)

INGEST = f"""{READINGS},
texts AS (
  SELECT *, date_trunc('minute', ts) AS minute, file_order % 101 = 50 AS no_time,
    CASE WHEN file_order % 211 BETWEEN 7 AND 10 THEN NULL ELSE room_temp END AS room_read,
    box_id = 2 AND sensor_id = 16 AS unnamed, lpad(CAST(file_order // 67108864 AS VARCHAR), 8, '0') AS part
  FROM r),
logs AS (
  SELECT *, CASE WHEN unnamed THEN 'GX-' ELSE 'GW_' END || box_id || '.' || sensor_id || '_' || part || '.csv' AS log,
    (surface_temp IS NULL)::INT + (internal_temp IS NULL)::INT >= 2 AS bad FROM texts),
cuts AS (
  SELECT period, log, min(file_order) FILTER (bad) AS cut, min(file_order) AS head FROM logs GROUP BY period, log),
kept AS (
  SELECT logs.* FROM logs JOIN cuts USING (period, log) WHERE cut IS NULL OR cut = head OR file_order < cut),
loaded AS (SELECT * FROM kept WHERE NOT no_time AND NOT unnamed),
status AS (
  SELECT c.period, c.log AS file,
    CASE WHEN c.log LIKE 'GX%' THEN NULL ELSE CAST(regexp_extract(c.log, 'GW_(\\d+)', 1) AS INTEGER) END AS box_id,
    CASE WHEN c.log LIKE 'GX%' THEN NULL ELSE CAST(regexp_extract(c.log, '\\.(\\d+)_', 1) AS INTEGER) END AS sensor_id,
    CASE WHEN c.log LIKE 'GX%' THEN 'unparsable name' WHEN n IS NULL THEN 'no valid time' END AS reason,
    coalesce(n, 0) AS rows
  FROM cuts c LEFT JOIN (SELECT period, log, count(*) AS n FROM loaded GROUP BY ALL) USING (period, log))"""

AUDITED = f"""{INGEST},
audit_bad AS (SELECT *, (surface_temp IS NULL)::INT + (internal_temp IS NULL)::INT + (wall_type IS NULL)::INT >= 2 AS bad2 FROM logs),
audit_cuts AS (
  SELECT period, log, min(file_order) FILTER (bad2) AS cut2, min(file_order) AS head2 FROM audit_bad GROUP BY period, log),
audited AS (
  SELECT a.* REPLACE (CASE WHEN no_time THEN NULL ELSE minute END AS minute, CASE WHEN unnamed THEN NULL ELSE box_id END AS box_id,
    CASE WHEN unnamed THEN NULL ELSE sensor_id END AS sensor_id, CASE WHEN unnamed THEN NULL ELSE wall_id END AS wall_id,
    CASE WHEN unnamed THEN NULL ELSE pos END AS pos)
  FROM audit_bad a JOIN audit_cuts USING (period, log) WHERE cut2 IS NULL OR cut2 = head2 OR file_order < cut2)"""

CURATED_LEVELS = f"""{INGEST},
clipped AS (
  SELECT * FROM logs WHERE period = 'Period2' AND NOT no_time AND NOT unnamed
    AND minute BETWEEN TIMESTAMP '2024-01-18 11:00:00' AND TIMESTAMP '2024-01-26 11:59:59'),
clip_cuts AS (SELECT log, min(file_order) FILTER (bad) AS cut2, min(file_order) AS head2 FROM clipped GROUP BY log),
left_over AS (
  SELECT clipped.* FROM clipped JOIN clip_cuts USING (log) WHERE cut2 IS NULL OR cut2 = head2 OR file_order < cut2),
sensors AS (
  SELECT period, box_id, sensor_id, time_bucket(INTERVAL '6 hours', minute) AS bin, avg(internal_temp) AS internal_temp
  FROM left_over GROUP BY ALL)"""

VERDICTS = f"""{READINGS},{SLICES},{RANGES},
facts AS (
  SELECT source_period, file, min(ts) AS orig_start, max(ts) AS orig_end, count(*) AS n,
    count(*) FILTER (ts BETWEEN lo AND hi) AS n_in, any_value(lo) AS lo, any_value(hi) AS hi
  FROM slices JOIN ranges ON ranges.period = source_period GROUP BY source_period, file),
judged AS (
  SELECT *, CASE
      WHEN source_period = 'Period1' THEN CASE WHEN orig_start >= lo AND orig_end <= hi THEN NULL ELSE 'outside period' END
      WHEN n_in > 0 THEN NULL
      WHEN orig_end >= lo THEN 'no rows in period range'
      WHEN orig_start >= TIMESTAMP '2024-01-01' AND orig_end <= TIMESTAMP '2024-01-11 23:59:59' THEN 'belongs to another period'
      ELSE 'outside period' END AS reason FROM facts),
verdicts AS (
  SELECT source_period, file, orig_start, orig_end, reason,
    CASE WHEN reason IS NULL AND source_period = 'Period2' THEN n_in ELSE n END AS rows,
    CASE WHEN reason IS NULL THEN source_period ELSE 'excluded' END AS status, lo, hi FROM judged)"""

CURATED = f"""SELECT v.status AS period, file, file_order, ts AS timestamp, {nine(*MEASURES)}
FROM slices JOIN verdicts v USING (source_period, file)
WHERE v.status <> 'excluded' AND (source_period = 'Period1' OR ts BETWEEN lo AND hi)"""


def _missing_times() -> str:
    cells = " UNION ALL ".join(
        f"SELECT period, file, ts, '{m}' AS measure FROM r JOIN ranges USING (period) "
        f"WHERE ts BETWEEN lo AND hi AND {m} IS NULL"
        for m in CHECKED
    )
    return f"""WITH {READINGS},{RANGES}, cells AS ({cells})
SELECT period, file, measure, string_agg(strftime(ts, '%Y-%m-%d %H:%M:%S'), ', ' ORDER BY ts) AS missing_at
FROM cells GROUP BY period, file, measure HAVING count(*) < 7"""


def _correlation_matrix() -> str:
    names = {
        f"{name}_{base}": f"avg({base}_temp) FILTER (box_id = {box})"
        for base in ("internal", "room", "surface")
        for box, name in ((1, "Control"), (2, "Experimental"))
        if (base, box) != ("room", 2)
    }
    columns = ", ".join(f"{sql} AS {name}" for name, sql in names.items())
    cells = " UNION ALL ".join(
        f"SELECT '{a}' AS row_name, '{c}' AS column_name, {nine(f'corr({a}, {c}) AS r')} FROM t"
        for a in names
        for c in names
    )
    return f"WITH {levels()}, t AS (SELECT bin, {columns} FROM b GROUP BY bin) {cells}"


def _relationship(x: str, y: str) -> str:
    return f"""WITH {levels()} SELECT wall_type, {nine('x AS x_binned', 'avg(y) AS y_mean')}, count(*) AS n
FROM (SELECT wall_type, {x} AS x, {y} AS y FROM w WHERE wall_type IS NOT NULL) WHERE x IS NOT NULL GROUP BY wall_type, x"""


def _detail(prefix: str, suffix: str, room: str) -> str:
    internal, surface = f"{prefix}internal{suffix}", f"{prefix}surface{suffix}"
    walls = "out_normalized_surface" if prefix else "out_surface"
    return f"""WITH {levels()},
o AS (SELECT period, box_id, bin, avg({walls}) AS outside_surface FROM w GROUP BY ALL)
SELECT period, box_id, bin AS timestamp,
  {nine(f'{internal} AS internal', f'{surface} AS inside_surface', 'outside_surface', f'{room} AS room')}
FROM b LEFT JOIN o USING (period, box_id, bin)"""


def _summary() -> str:
    measures = [
        "out_normalized_internal", "in_normalized_internal", "surface_gradient", "internal_gradient",
    ]
    cells = ", ".join(
        f"round_even({f}({m}) * 100, 0) / 100 + 0.0::DOUBLE AS {m}_{n}"
        for m in measures
        for f, n in (("avg", "mean"), ("stddev_samp", "std"))
    )
    return f"WITH {levels()} SELECT period, wall_type, {cells} FROM w WHERE wall_type IS NOT NULL GROUP BY ALL"


def _regime_summary() -> str:
    measures = [
        "out_surface", "out_internal", "out_normalized_surface", "out_normalized_internal",
        "in_surface", "in_internal", "in_normalized_surface", "in_normalized_internal",
        "gradient_air_to_out_surface", "gradient_out_to_in_surface", "gradient_in_surface_to_internal",
        "total_gradient", "surface_gradient", "internal_gradient",
    ]
    means = nine(*[f"avg({m}) AS {m}_mean" for m in measures])
    return f"""WITH {levels()},{REGIMES},
full_regimes AS (SELECT *, out_surface - room_temp AS gradient_air_to_out_surface,
  in_surface - out_surface AS gradient_out_to_in_surface, internal_avg - in_surface AS gradient_in_surface_to_internal,
  internal_avg - room_temp AS total_gradient FROM regimes WHERE box_id = 2)
SELECT period, wall_id, wall_type, regime_id, min(bin) AS timestamp_min, max(bin) AS timestamp_max,
  count(*) AS timestamp_count, {means} FROM full_regimes GROUP BY period, wall_id, wall_type, regime_id"""


def _comparison() -> str:
    cells = nine(
        *[
            f"avg({c}) FILTER (box_id = {box}) AS {name}_{label}"
            for box, name in ((1, "control"), (2, "experimental"))
            for c, label in (
                ("in_internal", "internal"),
                ("in_surface", "surface"),
                ("out_surface", "out_surface"),
            )
        ]
    )
    return f"WITH {levels()} SELECT period, wall_id, bin AS timestamp, {cells} FROM w GROUP BY period, wall_id, bin"


def _delta(where: str, out: str, inside: str, total: str) -> str:
    return f"""WITH {levels()} SELECT wall_type, bin AS timestamp,
  {nine(f'avg({out}) - avg({inside}) AS surface_delta', f'{total} AS total_delta')}
FROM w WHERE wall_type IS NOT NULL{where} GROUP BY wall_type, bin"""


def _sensor_list(present: bool, position: str | None = None) -> str:
    """Comma-joined sensors 1..16 found (or not) in the group's rows."""
    where = "" if position is None else f" FILTER (pos = '{position}')"
    found = f"coalesce(list(DISTINCT sensor_id){where}, [])"
    test = "list_contains" if present else "NOT list_contains"
    return f"array_to_string(list_filter(range(1, 17), lambda x: {test}({found}, x::INTEGER)), ',')"


EXPECTED_BOXES = "(VALUES ('Period1', 1), ('Period1', 2), ('Period2', 1), ('Period2', 2)) AS e(period, box_id)"


def _valid_rollup(where: str) -> str:
    return f"""WITH {READINGS},{RANGES},
j AS (SELECT r.*, ts BETWEEN lo AND hi AS ok FROM r JOIN ranges USING (period){where}),
u AS (SELECT period, box_id, -1 AS wall, count(DISTINCT file) AS n_files, count(*) AS rows,
    count(*) FILTER (ok) AS valid_rows FROM j GROUP BY period, box_id
  UNION ALL SELECT period, box_id, wall_id, count(DISTINCT file), count(*), count(*) FILTER (ok) FROM j GROUP BY period, box_id, wall_id),
every AS (SELECT period, box_id, CAST(wall AS INTEGER) AS wall FROM {EXPECTED_BOXES}, (VALUES (-1), (1), (2), (3), (4)) AS x(wall))
SELECT period, box_id, CASE box_id WHEN 1 THEN 'Control' ELSE 'Experimental' END AS box_name, nullif(wall, -1) AS wall_id,
  coalesce(n_files, 0) AS n_files, CAST(CASE WHEN wall = -1 THEN 16 ELSE 4 END AS BIGINT) AS n_expected,
  coalesce(rows, 0) AS rows, coalesce(valid_rows, 0) AS valid_rows
FROM every LEFT JOIN u USING (period, box_id, wall)"""


def oracle_sql() -> dict[str, str]:
    nine_s = nine(*MEASURES)
    normalized = nine("normalized_surface", "normalized_internal")
    percent = nine(*[f"{m} * 100.0::DOUBLE / rows AS {m}_pct" for m in MISSING])
    return {
        "resample_10min": f"WITH {sensor('10 minutes')} SELECT {SENSOR_COLUMNS}{nine_s} FROM s",
        "modal_value": f"""WITH {READINGS} SELECT period, box_id, sensor_id, day, label FROM (
SELECT period, box_id, sensor_id, CAST(ts AS DATE) AS day, label,
  row_number() OVER (PARTITION BY period, box_id, sensor_id, CAST(ts AS DATE) ORDER BY count(*) DESC, label) AS rn
FROM r WHERE label IS NOT NULL GROUP BY period, box_id, sensor_id, CAST(ts AS DATE), label) WHERE rn = 1""",
        "bin_completeness": f"""WITH {sensor('10 minutes')}
SELECT period, bin AS timestamp, count(*) AS n_values, count(*) = 32 AS complete FROM s GROUP BY period, bin""",
        "bin_count_histogram": f"""WITH {sensor('10 minutes')} SELECT period, n_values, count(*) AS n_bins
FROM (SELECT period, bin, count(*) AS n_values FROM s GROUP BY period, bin) GROUP BY period, n_values""",
        "incomplete_bins_first": f"""WITH {sensor('10 minutes')}
SELECT period, bin AS timestamp, count(*) AS n_values, false AS complete FROM s GROUP BY period, bin
HAVING count(*) <> 32 ORDER BY period, bin LIMIT 10""",
        "normalized_temps": f"WITH {sensor('10 minutes')} SELECT {SENSOR_COLUMNS}{nine_s}, {normalized} FROM s",
        "wall_level": f"WITH {levels()} SELECT {WALL_COLUMNS} FROM w",
        "box_level": f"WITH {levels()} SELECT {BOX_COLUMNS} FROM b",
        "gradient_by_type": f"""WITH {levels()},
g AS (SELECT wall_type, avg(room_temp) AS room_temp, avg(out_surface) AS out_surface, avg(in_surface) AS in_surface,
  avg(in_internal) AS in_internal FROM w WHERE wall_type IS NOT NULL GROUP BY wall_type)
SELECT wall_type, {nine('room_temp', 'out_surface', 'in_surface', 'in_internal',
    'out_surface - in_surface AS surface_gradient', 'room_temp - in_internal AS total_gradient')} FROM g
WHERE room_temp IS NOT NULL AND out_surface IS NOT NULL AND in_surface IS NOT NULL AND in_internal IS NOT NULL""",
        "profile_by_type": f"""WITH {levels()} SELECT wall_type, bin AS timestamp,
  {nine('avg(out_surface) AS out_surface', 'avg(in_surface) AS in_surface')}
FROM w WHERE box_id = 2 AND wall_type IS NOT NULL GROUP BY wall_type, bin""",
        "delta_series": _delta("", "out_surface", "in_surface", "avg(room_temp) - avg(in_internal)"),
        "delta_series_normalized": _delta(
            " AND period = 'Period1'",
            "out_normalized_surface",
            "in_normalized_surface",
            "-avg(in_normalized_internal)",
        ),
        "relationship_binned": _relationship("round_even(room_temp * 10, 0) / 10", "in_internal"),
        "relationship_binned_normalized": _relationship(
            "round_even(out_normalized_surface * 10, 0) / 10", "in_normalized_internal"
        ),
        "relationship_room_zero": _relationship("0.0::DOUBLE", "in_normalized_surface"),
        "correlation_matrix": _correlation_matrix(),
        "summary_table": _summary(),
        "room_mean": f"""WITH {levels('10 minutes')} SELECT bin AS timestamp, {nine('avg(room_temp) AS room_temp')}
FROM b GROUP BY bin""",
        "wall_internal_mean": f"""WITH {levels()} SELECT bin AS timestamp, {nine('avg(in_internal) AS in_internal')}
FROM w WHERE box_id = 2 AND wall_id IN (1, 2, 4) GROUP BY bin""",
        "box_detail_profile": _detail("", "_temp", "room_temp"),
        "box_detail_profile_normalized": _detail("normalized_", "", "0.0::DOUBLE"),
        "sensor_vs_box_mean": f"""WITH {sensor('6 hours')},
c AS (SELECT * FROM s WHERE box_id = 1 AND sensor_id IN (1, 2, 5, 9, 12)),
m AS (SELECT period, box_id, bin, avg(internal_temp) AS box_mean FROM c GROUP BY ALL)
SELECT period, box_id, bin AS timestamp, sensor_id, pos AS position,
  {nine('internal_temp AS value', 'box_mean', 'internal_temp - box_mean AS deviation')}
FROM c JOIN m USING (period, box_id, bin)""",
        "wall_comparison": _comparison(),
        "box_timeline": f"""WITH {levels()} SELECT period, bin AS timestamp, box_id,
  CASE box_id WHEN 1 THEN 'Control' ELSE 'Experimental' END AS box_name,
  {nine('internal_temp AS internal', 'surface_temp AS surface')} FROM b""",
        "wall_timeline": f"""WITH {levels()} SELECT period, bin AS timestamp, wall_id, {nine('in_surface', 'out_surface')}
FROM w WHERE box_id = 2 AND wall_id IN (1, 3)""",
        "smooth_30min": f"WITH {levels('10 minutes')} {smooth('b', 'period, box_id', BOX_SMOOTHED, BELOW_30MIN)}",
        "smooth_1h": f"WITH {levels('10 minutes')} {smooth('b', 'period, box_id', BOX_SMOOTHED, BELOW_1H)}",
        "smooth_3h": f"WITH {levels('10 minutes')} {smooth('b', 'period, box_id', BOX_SMOOTHED, BELOW_3H)}",
        "smooth_12h": f"WITH {levels('10 minutes')} {smooth('b', 'period, box_id', BOX_SMOOTHED, BELOW_12H)}",
        "smooth_30d": f"WITH {levels('10 minutes')} {smooth('b', 'period, box_id', BOX_SMOOTHED, BELOW_30D)}",
        "smooth_walls_12h": f"WITH {levels()} {smooth('w', 'period, box_id, wall_id', WALL_SMOOTHED, BELOW_12H)}",
        "change_events": f"""WITH {levels()},{REGIMES}
SELECT period, box_id, wall_id, bin AS timestamp, wall_type FROM regimes WHERE changed = 1""",
        "regimes": f"""WITH {levels()},{REGIMES}
SELECT period, box_id, wall_id, bin AS timestamp, wall_type, regime_id FROM regimes""",
        "regime_summary": _regime_summary(),
        "thermal_lag": f"""WITH {levels()},{LAG}
SELECT wall_type, lag_minutes, {nine('r')} FROM (SELECT DISTINCT wall_type FROM series) LEFT JOIN lagged USING (wall_type)""",
        "noon_probes": f"WITH {READINGS},{PROBES} SELECT period, probe_time FROM probes",
        "noon_probes_first_days": f"""WITH {READINGS},{PROBES}
SELECT probe_time FROM probes ORDER BY probe_time LIMIT 8""",
        "nearest_probe": f"""WITH {READINGS},{MATCHES}
SELECT period, probe_time, file, ts AS match_time, {nine_s}, wall_type, ts IS NOT NULL AS has_data,
  hi = 1 AND room_temp IS NOT NULL AS is_max, lo = 1 AND room_temp IS NOT NULL AS is_min FROM ranked""",
        "regenerated_timestamps": f"""WITH {READINGS},
n AS (SELECT *, row_number() OVER (PARTITION BY period, file ORDER BY file_order) - 1 AS row_index FROM r),
t AS (SELECT *, TIMESTAMP '2025-12-03 11:11:00' + row_index * INTERVAL 10 MINUTE AS t0 FROM n)
SELECT period, file, file_order, row_index, {nine_s}, t0 AS timestamp, strftime(t0, '%-m/%-d/%Y %-H:%M') AS date_text FROM t""",
        "repaired_clocks": f"""WITH {READINGS},
n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY file_order) - 1 AS row_index FROM r
  WHERE file IN ('GW_2.1_121125.csv', 'GW_2.13_121125.csv', 'GW_2.8_121125.csv', 'GW_1.8_121125.csv'))
SELECT file, file_order, row_index, {nine('internal_temp')},
  TIMESTAMP '2025-12-03 11:11:00' + row_index * INTERVAL 10 MINUTE AS timestamp FROM n""",
        "topology_lookup": f"WITH {READINGS} SELECT file, file_order, box_id, sensor_id, wall_id, pos AS position FROM r",
        "period_filter": f"WITH {levels()} SELECT {BOX_COLUMNS} FROM b WHERE period = 'Period2'",
        "range_filter": f"""WITH {READINGS},{RANGES} SELECT period, file, file_order, ts AS timestamp, {nine_s}
FROM r JOIN ranges USING (period) WHERE ts BETWEEN lo AND hi""",
        "wall_type_choices": f"WITH {READINGS} SELECT DISTINCT wall_type FROM r WHERE wall_type IS NOT NULL",
        "exclude_sensors_wall": f"WITH {levels(sensors=KEPT_SENSORS)} SELECT {WALL_COLUMNS} FROM w",
        "exclude_sensors_box": f"WITH {levels(sensors=KEPT_SENSORS)} SELECT {BOX_COLUMNS} FROM b",
        "answer_smoothed": f"""WITH {levels('10 minutes', KEPT_SENSORS)},
p AS (SELECT * FROM b WHERE period = 'Period2'),
sm AS ({smooth('p', 'period, box_id', BOX_SMOOTHED, BELOW_3H)})
SELECT period, timestamp, box_id, CASE box_id WHEN 1 THEN 'Control' ELSE 'Experimental' END AS box_name,
  normalized_internal_smooth AS internal, normalized_surface_smooth AS surface FROM sm""",
        "missing_sensors": f"""WITH {READINGS}
SELECT period, box_id, CAST(g.s AS INTEGER) AS sensor_id FROM {EXPECTED_BOXES}, range(1, 17) g(s)
EXCEPT SELECT period, box_id, sensor_id FROM r""",
        "missing_sensors_absent_box": f"""WITH {READINGS}
SELECT period, box_id, CAST(g.s AS INTEGER) AS sensor_id FROM {EXPECTED_BOXES}, range(1, 17) g(s)
EXCEPT SELECT period, box_id, sensor_id FROM r WHERE NOT (period = 'Period2' AND box_id = 2)""",
        "missing_sensors_by_bin": f"""WITH {sensor('10 minutes')}
SELECT period, box_id, bin AS timestamp, CAST(g.s AS INTEGER) AS sensor_id
FROM (SELECT DISTINCT period, box_id, bin FROM s), range(1, 17) g(s)
EXCEPT SELECT period, box_id, bin, sensor_id FROM s""",
        "missing_sensors_on_grid": f"""WITH {sensor('10 minutes')},
p(period, a, b) AS (VALUES ('Period1', TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-11 23:59:59'),
  ('Period2', TIMESTAMP '2024-01-18 11:00:00', TIMESTAMP '2024-01-26 11:59:59')),
grid AS (SELECT period, unnest(generate_series(a, b, INTERVAL 10 MINUTE)) AS timestamp FROM p)
SELECT period, box_id, timestamp, CAST(g.s AS INTEGER) AS sensor_id
FROM grid, (VALUES (1), (2)) AS e(box_id), range(1, 17) g(s)
EXCEPT SELECT period, box_id, bin, sensor_id FROM s""",
        "missing_profile": f"WITH {READINGS},{FILES} SELECT period, file, rows, {', '.join(MISSING)}, {percent} FROM files",
        "missing_by_column": f"""WITH {READINGS},{FILES},
t AS (SELECT *, {ALL_MISSING} AS total_missing FROM files),
u AS ({' UNION ALL '.join(f"SELECT period, file, total_missing, '{m}' AS measure, missing_{m} AS n_missing FROM t" for m in CHECKED)})
SELECT *, CASE WHEN total_missing = 0 THEN 'none' WHEN total_missing < 10 THEN 'listed' ELSE 'too many' END AS verdict FROM u""",
        "rows_with_missing": f"""WITH {READINGS},
g AS (SELECT period, file, file_order, (surface_temp IS NULL)::INT + (internal_temp IS NULL)::INT + (room_temp IS NULL)::INT + (wall_type IS NULL)::INT AS n_missing FROM r)
SELECT period, file, file_order, n_missing FROM (SELECT *, sum(n_missing) OVER (PARTITION BY period, file) AS total FROM g)
WHERE n_missing > 0 AND total < 10""",
        "type_distribution": f"""WITH {READINGS}, c AS (SELECT period, file, wall_type, count(*) AS n FROM r GROUP BY ALL)
SELECT period, file, wall_type, n, {nine('n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY period, file) AS pct')} FROM c""",
        "sensor_mapping": f"""WITH {READINGS},
c AS (SELECT period, file, box_id, sensor_id, wall_id, pos, wall_type, count(*) AS n, min(file_order) AS head FROM r GROUP BY ALL),
t AS (SELECT period, file, box_id, sensor_id, wall_id, pos, CAST(sum(n) AS BIGINT) AS rows, count(wall_type) AS n_wall_types,
  string_agg(wall_type, ', ' ORDER BY head) AS txt FROM c GROUP BY ALL)
SELECT * EXCLUDE (txt, pos), pos AS position, CASE WHEN txt IS NULL THEN 'N/A' WHEN length(txt) > 28 THEN left(txt, 25) || '...' ELSE txt END AS wall_types FROM t""",
        "sensor_availability": f"""WITH {READINGS}
SELECT period, box_id, CAST(ts AS DATE) AS day, count(DISTINCT sensor_id) AS n_found,
  16 - count(DISTINCT sensor_id) AS n_missing, {_sensor_list(True)} AS found, {_sensor_list(False)} AS missing
FROM r GROUP BY period, box_id, CAST(ts AS DATE)""",
        "sensor_availability_wide": f"""WITH {READINGS},
v AS (SELECT period, box_id, CAST((file_order // 2) % 20 + 1 AS INTEGER) AS sensor_id FROM r WHERE sensor_id <> 3)
SELECT period, box_id, count(DISTINCT sensor_id) AS n_found,
  16 - count(DISTINCT sensor_id) FILTER (sensor_id <= 16) AS n_missing,
  array_to_string(list_sort(list(DISTINCT sensor_id)), ',') AS found, {_sensor_list(False)} AS missing
FROM v GROUP BY period, box_id""",
        "coverage": f"""WITH {READINGS} SELECT period, box_id, wall_id, count(DISTINCT sensor_id) AS n_sensors,
  CAST(4 AS BIGINT) AS n_expected, {_sensor_list(True, 'out')} AS out_sensors, {_sensor_list(True, 'in')} AS in_sensors
FROM r GROUP BY period, box_id, wall_id""",
        "period_summary": f"""WITH {READINGS} SELECT period, count(*) AS rows, count(DISTINCT sensor_id) AS n_sensors,
  count(DISTINCT box_id) AS n_boxes, min(ts) AS min_time, max(ts) AS max_time,
  CAST((epoch_us(max(ts)) - epoch_us(min(ts))) // 86400000000 AS BIGINT) AS duration_days FROM r GROUP BY period""",
        "sensor_summary": f"""WITH {READINGS},{FILES} SELECT period, box_id, sensor_id, wall_id, pos AS position,
  CAST(sum(rows) AS BIGINT) AS rows, {MISSING_SUMS} FROM files GROUP BY ALL""",
        "file_profile": f"""WITH {READINGS},{FILES},
t AS (SELECT *, {ALL_MISSING} AS null_count FROM files)
SELECT period, file, 'SUCCESS' AS status, rows, min_time, max_time, null_count > 0 AS has_nulls, null_count FROM t""",
        "range_check": f"""WITH {READINGS},{SLICES},{RANGES},
j AS (SELECT s.period, s.file, ts, ts BETWEEN lo AND hi AS ok FROM slices s JOIN ranges USING (period))
SELECT period, file, count(*) FILTER (ok) AS valid_rows, count(*) FILTER (NOT ok) AS invalid_rows, count(*) AS total_rows,
  CASE WHEN count(*) FILTER (NOT ok) < 10 THEN string_agg(strftime(ts, '%Y-%m-%d %H:%M:%S'), ', ' ORDER BY ts) FILTER (NOT ok) END AS invalid_times,
  {nine('count(*) FILTER (ok) * 100.0::DOUBLE / count(*) AS percent_valid')}
FROM j GROUP BY period, file""",
        "valid_rollup_absent_box": _valid_rollup(" WHERE NOT (r.period = 'Period2' AND box_id = 2)"),
        "valid_rollup": _valid_rollup(""),
        "rows_per_day": f"""WITH {READINGS}, d AS (SELECT period, file, CAST(ts AS DATE) AS day, count(*) AS rows FROM r GROUP BY ALL)
SELECT period, file, day, rows, rows = 144 AS as_expected, {nine('avg(rows) OVER (PARTITION BY period, file) AS avg_per_day')} FROM d""",
        "audit_report": f"""WITH {READINGS},
x AS (SELECT *, (surface_temp IS NULL)::INT AS a, (internal_temp IS NULL)::INT AS c, (room_temp IS NULL)::INT AS d,
  (wall_type IS NULL)::INT AS e FROM r)
{' UNION ALL '.join(f'''SELECT '{level}' AS level, period, {box} AS box_id, {wall} AS wall_id, count(DISTINCT file) AS n_files,
  count(*) AS rows, min(ts) AS min_time, max(ts) AS max_time, CAST(sum(a) AS BIGINT) AS missing_surface_temp,
  CAST(sum(c) AS BIGINT) AS missing_internal_temp, CAST(sum(d) AS BIGINT) AS missing_room_temp,
  CAST(sum(e) AS BIGINT) AS missing_wall_type, {lost} AS missing_sensors
FROM x GROUP BY {keys}''' for level, box, wall, lost, keys in (
    ('period', 'CAST(NULL AS INTEGER)', 'CAST(NULL AS INTEGER)', 'CAST(NULL AS VARCHAR)', 'period'),
    ('box', 'box_id', 'CAST(NULL AS INTEGER)', _sensor_list(False), 'period, box_id'),
    ('wall', 'box_id', 'wall_id', 'CAST(NULL AS VARCHAR)', 'period, box_id, wall_id')))}""",
        "readiness": f"""WITH {READINGS} SELECT bool_or(period = 'Period1') AS has_period1,
  bool_or(period = 'Period2') AS has_period2, bool_or(period = 'Period1') AND bool_or(period = 'Period2') AS ready FROM r""",
        "range_audit": f"""WITH {READINGS},{RANGES}, j AS (SELECT r.*, lo, ts BETWEEN lo AND hi AS ok FROM r JOIN ranges USING (period))
SELECT period, file, box_id, sensor_id, min(ts) AS orig_start, max(ts) AS orig_end, count(*) AS orig_rows,
  count(*) FILTER (ok) AS range_rows,
  {', '.join(f'count(*) FILTER (ok AND {m} IS NULL) AS missing_{m}' for m in CHECKED)},
  CAST(min(ts) AS DATE) <> CAST(any_value(lo) AS DATE) AS other_start_day, count(*) FILTER (ok) < 5 AS very_few_rows
FROM j GROUP BY period, file, box_id, sensor_id""",
        "missing_times": _missing_times(),
        "first_readings": f"""WITH {READINGS}
SELECT period, file, file_order, ts AS timestamp, {nine_s}, wall_type
FROM (SELECT *, row_number() OVER (PARTITION BY period, file ORDER BY file_order) AS rn FROM r) WHERE rn = 1""",
        "overview": f"""WITH {levels('10 minutes')}
SELECT 'sensor' AS level, count(*) AS rows, count(DISTINCT period) AS n_periods, count(DISTINCT (box_id, sensor_id)) AS n_items FROM s
UNION ALL SELECT 'wall', count(*), count(DISTINCT period), count(DISTINCT (box_id, wall_id)) FROM w
UNION ALL SELECT 'box', count(*), count(DISTINCT period), count(DISTINCT box_id) FROM b""",
        "logger_ingest": f"""WITH {INGEST} SELECT period, log AS file, box_id, sensor_id, wall_id, pos AS position, minute AS timestamp,
  {nine('surface_temp', 'internal_temp', 'room_read AS room_temp')}, wall_type FROM loaded""",
        "logger_file_status": f"WITH {INGEST} SELECT period, file, box_id, sensor_id, reason, rows FROM status",
        "logger_load_summary": f"""WITH {INGEST} SELECT period, count(*) + (period = 'Period1')::INT AS n_files,
  count(*) FILTER (reason IS NULL) AS n_loaded, count(*) FILTER (reason IS NOT NULL) + (period = 'Period1')::INT AS n_failed, CAST(sum(rows) AS BIGINT) AS rows FROM status GROUP BY period""",
        "audit_ingest": f"""WITH {AUDITED} SELECT period, log AS file, box_id, sensor_id, wall_id, pos AS position, minute AS timestamp,
  {nine('surface_temp', 'internal_temp', 'room_read AS room_temp')}, wall_type FROM audited""",
        "audit_file_profile": f"""WITH {AUDITED},
t AS (SELECT period, log AS file, count(*) AS rows, min(minute) AS min_time, max(minute) AS max_time,
  count(*) FILTER (minute IS NULL) + count(*) FILTER (surface_temp IS NULL) + count(*) FILTER (internal_temp IS NULL)
  + count(*) FILTER (room_read IS NULL) + count(*) FILTER (wall_type IS NULL) AS null_count FROM audited GROUP BY period, log)
SELECT period, file, 'SUCCESS' AS status, rows, min_time, max_time, null_count > 0 AS has_nulls, null_count FROM t
UNION ALL SELECT 'Period1', 'GW_1.1_empty.csv', 'FAILED', 0, NULL, NULL, NULL, NULL""",
        "curated_levels": f"""WITH {CURATED_LEVELS} SELECT period, box_id, bin AS timestamp, count(*) AS sensor_count,
  {nine('avg(internal_temp) AS internal_temp')} FROM sensors GROUP BY period, box_id, bin""",
        "quarantine_reload": f"""WITH {INGEST} SELECT 'excluded' AS status, period AS source_period, period || '_' || log AS file,
  'outside period' AS reason, count(*) + 15 AS n_lines FROM logs WHERE box_id = 1 AND period = 'Period1' GROUP BY period, log""",
        "curation_verdicts": f"""WITH {VERDICTS}
SELECT source_period, file, orig_start, orig_end, reason, rows, status FROM verdicts""",
        "curation_totals": f"""WITH {VERDICTS}
SELECT status, count(*) AS n_files, CAST(sum(rows) AS BIGINT) AS rows FROM verdicts GROUP BY status""",
        "curated_rows": f"WITH {VERDICTS} {CURATED}",
        "quarantined_rows": f"""WITH {VERDICTS} SELECT source_period, source_period || '_' || file AS file, file_order, ts AS timestamp,
  {nine_s}, v.status, v.reason FROM slices JOIN verdicts v USING (source_period, file) WHERE v.status = 'excluded'""",
        "curated_reload": f"WITH {VERDICTS} SELECT * FROM ({CURATED}) WHERE period = 'Period2'",
        "export_reload": f"""WITH {levels()} SELECT period, box_id, bin AS timestamp, {nine('internal_temp')}, sensor_count
FROM b WHERE period = 'Period1'""",
    }
