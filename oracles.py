"""SQL equivalents of the registered queries, for DuckDB on the same tables."""

from __future__ import annotations

LOGON, HTTP, DEVICE = "('signup', 'error')", "('view', 'click')", "('purchase')"
START, END = "DATE '2024-01-08'", "DATE '2024-01-21'"
IN_RANGE = f"date >= {START} AND date <= {END}"
MEASURES = ("logon_count", "http_requests", "device_activity_count")
SPIKES = ("logon_spike", "http_spike", "device_spike")
SIX = "round({0}, 6) + 0.0 AS {0}"


def _trunc(grain: str) -> str:
    return "ts" if grain == "raw" else f"CAST(date_trunc('{grain}', ts) AS TIMESTAMP)"


def _source(kinds: str, grain: str, measures: str) -> str:
    return (
        f'SELECT user_id AS "user", {_trunc(grain)} AS date, {measures} FROM events '
        f"WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_type IN {kinds} GROUP BY 1, 2"
    )


BYTES = (
    "count(event_type) AS http_requests, coalesce(sum(value), 0.0) AS http_bytes_sent, "
    "CAST(coalesce(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)), 0) AS BIGINT) AS http_bytes_received"
)


def _activity(grain: str) -> str:
    """Three aggregates, full outer joined, gaps filled with 0."""
    return f"""
  logon AS ({_source(LOGON, grain, "count(event_type) AS logon_count")}),
  http AS ({_source(HTTP, grain, BYTES)}),
  device AS ({_source(DEVICE, grain, "count(event_type) AS device_activity_count")}),
  activity AS (
    SELECT "user", date, coalesce(logon_count, 0) AS logon_count, coalesce(http_requests, 0) AS http_requests,
      coalesce(http_bytes_sent, 0.0) AS http_bytes_sent, coalesce(http_bytes_received, 0) AS http_bytes_received,
      coalesce(device_activity_count, 0) AS device_activity_count
    FROM logon FULL OUTER JOIN http USING ("user", date) FULL OUTER JOIN device USING ("user", date)
  )"""


CALENDAR = """
      CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, CAST(day(date) AS INTEGER) AS day,
      CAST(isodow(date) - 1 AS INTEGER) AS weekday, CAST(hour(date) AS INTEGER) AS hour,
      CAST(minute(date) AS INTEGER) AS minute, CAST(isodow(date) < 6 AS INTEGER) AS is_working_day,
      CAST((day(date) - 1) // 7 + 1 AS INTEGER) AS week_of_month,
      CAST(hour(date) < 7 OR hour(date) > 19 AS INTEGER) AS is_off_hours"""


def _features(grain: str) -> str:
    stats = ", ".join(f"avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_std" for c in MEASURES)
    spikes = ", ".join(
        f"({c} - {c}_mean) / nullif({c}_std, 0) AS {s}" for s, c in zip(SPIKES, MEASURES, strict=True)
    )
    return f"""{_activity(grain)},
  baseline AS (SELECT "user", {stats} FROM activity GROUP BY "user"),
  features AS (
    SELECT *, logon_count - logon_rolling_3 AS logon_delta FROM (
      SELECT activity.*, {spikes},
        device_activity_count / (http_requests + 1) AS device_http_ratio,
        logon_count / (http_requests + 1) AS logon_http_ratio, {CALENDAR},
        avg(logon_count) OVER (PARTITION BY "user" ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
          AS logon_rolling_3
      FROM activity LEFT JOIN baseline USING ("user")
    )
  )"""


def _risk(grain: str) -> str:
    score = " + ".join(f"coalesce(abs({s}), 0.0)" for s in SPIKES)
    return f"""{_features(grain)},
  scored AS (SELECT *, round({score}, 6) AS risk_score FROM features),
  cuts AS (
    SELECT quantile_cont(risk_score, 0.75) AS medium_from, quantile_cont(risk_score, 0.95) AS high_from,
      quantile_cont(risk_score, 0.98) AS anomaly_from
    FROM scored
  ),
  scored_levels AS (
    SELECT scored.*, CASE WHEN risk_score < medium_from THEN 'Low' WHEN risk_score < high_from THEN 'Medium'
        ELSE 'High' END AS risk_level,
      CASE WHEN risk_score > anomaly_from THEN -1 ELSE 1 END AS anomaly
    FROM scored, cuts
  ),
  risk AS (SELECT * REPLACE (CAST(date AS DATE) AS date), date AS event_time FROM scored_levels)"""


def _with(steps: str, select: str) -> str:
    return f"WITH {steps.strip()}\n{select}"


def _six(*names: str) -> str:
    return ", ".join(SIX.format(n) for n in names)


FEATURE_LIST = (
    "logon_count, http_requests, "
    + _six("http_bytes_sent")
    + ", http_bytes_received, device_activity_count, "
    + _six(*SPIKES, "device_http_ratio", "logon_http_ratio")
    + ", hour, weekday, is_working_day, is_off_hours, "
    + _six("logon_rolling_3", "logon_delta")
)
FEATURE_NAMES = (
    "logon_count", "http_requests", "http_bytes_sent", "http_bytes_received", "device_activity_count", *SPIKES,
    "device_http_ratio", "logon_http_ratio", "hour", "weekday", "is_working_day", "is_off_hours",
    "logon_rolling_3", "logon_delta",
)
SCORE = _six("risk_score")
TOP_USERS = (
    'SELECT "user" FROM risk WHERE risk_level = \'High\' GROUP BY "user" ORDER BY count(*) DESC, "user" LIMIT 10'
)


def _scaled() -> str:
    def value(c: str) -> str:
        return f"coalesce(CAST({c} AS DOUBLE), 0.0)"

    columns = ", ".join(
        f"round(({value(c)} - (SELECT avg({value(c)}) FROM features)) / "
        f"coalesce(nullif((SELECT stddev_pop({value(c)}) FROM features), 0), 1), 6) + 0.0 AS {c}"
        for c in FEATURE_NAMES
    )
    return f'SELECT "user", date, {columns} FROM features'


def _histogram() -> str:
    return """
SELECT CAST(CASE WHEN high = low THEN 1
    ELSE least(floor((risk_score - low) / (high - low) * 50) + 1, 50) END AS BIGINT) AS bucket, count(*) AS count
FROM risk, (SELECT min(risk_score) AS low, max(risk_score) AS high FROM risk)
WHERE risk_score IS NOT NULL GROUP BY 1 ORDER BY 1"""


def _high_per(key: str, extra: str = "") -> str:
    return f"SELECT {key}, count(*) AS count{extra} FROM risk WHERE risk_level = 'High' GROUP BY {key} ORDER BY {key}"


# One user of 50 has unreadable dates, another unreadable byte counts.
REJECTED = f"""
SELECT log, problem, count(*) AS rows FROM (
  SELECT CASE WHEN event_type IN {LOGON} THEN 'logon' WHEN event_type IN {HTTP} THEN 'http' ELSE 'device' END AS log,
    CASE WHEN user_id % 50 = 7 THEN 'date' WHEN user_id % 50 = 8 AND event_type IN {HTTP} THEN 'bytes_received' END AS problem
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL
    AND event_type IN ('signup', 'error', 'view', 'click', 'purchase')
) WHERE problem IS NOT NULL GROUP BY ALL"""


def _kmeans(k: int = 8, rounds: int = 10, seed_rounds: int = 4) -> str:
    """k-means|| and then k-means, each round unrolled; the first of equally near centres wins."""
    names = range(len(FEATURE_NAMES))

    def value(c: str) -> str:
        return f"coalesce(CAST({c} AS DOUBLE), 0.0)"

    scaled = ", ".join(
        f"({value(c)} - (SELECT avg({value(c)}) FROM features)) / "
        f"coalesce(nullif((SELECT stddev_pop({value(c)}) FROM features), 0), 1) AS x{i}"
        for i, c in enumerate(FEATURE_NAMES)
    )
    gap = " + ".join(f"(s.x{i} - c.x{i}) * (s.x{i} - c.x{i})" for i in names)
    xs, ordered = ", ".join(f"round(x{i}, 6) AS x{i}" for i in names), ", ".join(f"x{i}" for i in names)
    steps = [
        f"""{_features("hour")}, scaled AS MATERIALIZED (SELECT "user", date, md5("user" || '|' || strftime(date, '%Y-%m-%d %H:%M:%S')) AS m, {scaled} FROM features),
        d0 AS MATERIALIZED (SELECT -1 AS turn, m, {xs} FROM scaled ORDER BY m, {ordered} LIMIT 1)"""
    ]
    for r in range(seed_rounds):
        steps.append(f'f{r} AS MATERIALIZED (SELECT s."user", s.date, any_value(s.m) AS m, min({gap}) AS far FROM scaled s, d{r} c GROUP BY s."user", s.date)')
        steps.append(
            f"d{r + 1} AS MATERIALIZED (SELECT * FROM d{r} UNION ALL SELECT {r} AS turn, s.m, {', '.join(f'round(s.x{i}, 6) AS x{i}' for i in names)} "
            f"FROM scaled s JOIN f{r} f ON f.\"user\" = s.\"user\" AND f.date = s.date "
            f"WHERE ('0x' || substr(md5(s.m || '|{r}'), 1, 8))::BIGINT / 4294967296.0 < far * {2.0 * k} / (SELECT sum(far) FROM f{r}))"
        )
    steps.append(f"c AS MATERIALIZED (SELECT row_number() OVER (ORDER BY turn, m, {ordered}) AS c, {ordered} FROM d{seed_rounds})")
    steps.append(
        f'w AS MATERIALIZED (SELECT c, count(n.c) AS w FROM c LEFT JOIN (SELECT min({{\'d\': {gap}, \'c\': c.c}}).c AS c FROM scaled s, c '
        'GROUP BY s."user", s.date) n USING (c) GROUP BY c)'
    )
    steps.append("p0 AS MATERIALIZED (SELECT 1 AS turn, c.* FROM c JOIN w USING (c) ORDER BY w.w DESC, c LIMIT 1)")
    for r in range(1, k):
        steps.append(
            f"p{r} AS MATERIALIZED (SELECT * FROM p{r - 1} UNION ALL (SELECT {r + 1} AS turn, s.* FROM c s JOIN w USING (c), p{r - 1} c "
            f"WHERE s.c NOT IN (SELECT c FROM p{r - 1}) GROUP BY ALL ORDER BY round(any_value(w.w) * min({gap}), 6) DESC, s.c LIMIT 1))"
        )
    steps.append(f"c0 AS MATERIALIZED (SELECT turn AS c, {ordered} FROM p{k - 1})")
    for r in range(rounds):
        means = ", ".join(f"coalesce(round(avg(n.x{i}), 6), any_value(c.x{i})) AS x{i}" for i in names)
        steps.append(
            f'n{r} AS MATERIALIZED (SELECT s."user", s.date, min({{\'d\': {gap}, \'c\': c.c}}).c AS c, '
            + ", ".join(f"any_value(s.x{i}) AS x{i}" for i in names)
            + f' FROM scaled s, c{r} c GROUP BY s."user", s.date)'
        )
        steps.append(
            f"c{r + 1} AS MATERIALIZED (SELECT c.c, {means} FROM c{r} c LEFT JOIN n{r} n ON n.c = c.c GROUP BY c.c)"
        )
    steps.append(
        f'd AS MATERIALIZED (SELECT s."user", s.date, round(sqrt(min({gap})), 6) AS risk_score '
        f'FROM scaled s, c{rounds} c GROUP BY s."user", s.date)'
    )
    steps.append(
        "cuts AS (SELECT quantile_cont(risk_score, 0.75) AS m, quantile_cont(risk_score, 0.95) AS h, "
        "quantile_cont(risk_score, 0.98) AS a FROM d)"
    )
    return _with(
        ", ".join(steps),
        'SELECT "user", date, CASE WHEN risk_score > a THEN -1 ELSE 1 END AS anomaly, risk_score, '
        "CASE WHEN risk_score < m THEN 'Low' WHEN risk_score < h THEN 'Medium' ELSE 'High' END AS risk_level FROM d, cuts",
    )


# --- forest: the same draws by MD5, trees split level by level, rows walked down all trees ---

WHOLE = ("logon_count", "http_requests", "device_activity_count", "hour", "weekday", "is_working_day", "is_off_hours")
FOREST_TREES, FOREST_SIZE, FOREST_DEPTH, FOREST_SEED = 200, 256, 8, 42
PRIME = 2**31 - 1
SPREAD = (1_103_515_245, 1_299_709_033, 1_618_033_989, 1_732_050_807)


def _steady(c: str) -> str:
    """Twelve significant digits of a fractional feature."""
    x = f"coalesce(CAST({c} AS DOUBLE), 0.0)"
    if c in WHOLE:
        return x
    power = f"least(312.0, 11.0 - floor(log10(abs({x}))))"
    scale = f"pow(10.0, abs({power}))"
    return (
        f"CASE WHEN {x} = 0 THEN 0.0 WHEN {power} >= 0 THEN round_even({x} * {scale}, 0) / {scale} "
        f"ELSE round_even({x} / {scale}, 0) * {scale} END"
    )


def _unit(part: int) -> str:
    return f"('0x' || substr(h, {8 * part + 1}, 8))::BIGINT / 4294967296.0"


def _coefficient(i: int) -> str:
    return f"(1 + ((t + 1) * {SPREAD[i]} + {(FOREST_SEED % PRIME) * (i + 7)}) % {PRIME - 1})"


def _forest(shares: tuple[float, ...]) -> str:
    """CTEs down to ``forest``: one row per feature row and share with its ``raw_score``."""
    width = len(FEATURE_NAMES)
    xs = ", ".join(_steady(c) for c in FEATURE_NAMES)
    settings = ", ".join(f"({round(s * 1000)}, {max(1, int(s * width))})" for s in shares)
    steps = [
        f"""{_features("hour")},
  rows AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, *, ('0x' || substr(k, 1, 7))::BIGINT AS m1, ('0x' || substr(k, 8, 7))::BIGINT AS m2
    FROM (SELECT *, md5("user" || '|' || date::VARCHAR) AS k, [{xs}] AS x FROM features)
  ),
  picked AS MATERIALIZED (
    SELECT t, rid, x FROM (
      SELECT t, rid, x, row_number() OVER (PARTITION BY t ORDER BY ({_coefficient(0)} * m1 + {_coefficient(1)}) % {PRIME} * {PRIME}
        + ({_coefficient(2)} * m2 + {_coefficient(3)}) % {PRIME}, "user", date) AS place
      FROM rows, (SELECT unnest(range({FOREST_TREES})) AS t)
      WHERE m1 * 268435456 + m2 < (SELECT least(1.0, ({64 * FOREST_SIZE} + 8 * sqrt({64 * FOREST_SIZE}) + 64) / count(*)) FROM rows) * 72057594037927936.0
    ) WHERE place <= {FOREST_SIZE}
  ),
  settings(share, width) AS (VALUES {settings}),
  chosen AS MATERIALIZED (
    SELECT share, t, i FROM (
      SELECT share, width, t, i, row_number() OVER (PARTITION BY share, t ORDER BY md5({FOREST_SEED} || '|' || share || '|' || t || '|c' || i)) AS place
      FROM settings, (SELECT unnest(range({FOREST_TREES})) AS t), (SELECT unnest(range({width})) AS i)
    ) WHERE place <= width
  ),
  n0 AS MATERIALIZED (SELECT share, t, rid, x, 0 AS node, NULL::INTEGER AS stopped FROM picked, settings)"""
    ]
    for level in range(FOREST_DEPTH):
        steps.append(
            f"""
  g{level} AS MATERIALIZED (
    SELECT *, CASE WHEN v.lo + u * (v.hi - v.lo) < v.hi THEN v.lo + u * (v.hi - v.lo) ELSE v.lo END AS cut FROM (
      SELECT share, t, node, v[CAST(floor({_unit(0)} * len(v)) AS BIGINT) + 1] AS v, {_unit(1)} AS u FROM (
        SELECT share, t, node, md5({FOREST_SEED} || '|' || share || '|' || t || '|' || node) AS h,
          list({{'i': i, 'lo': lo, 'hi': hi}} ORDER BY i) FILTER (hi > lo) AS v
        FROM (SELECT share, t, node, i, min(x[i + 1]) AS lo, max(x[i + 1]) AS hi FROM n{level} JOIN chosen USING (share, t) GROUP BY ALL)
        GROUP BY share, t, node
      )
    ) WHERE v IS NOT NULL
  ),
  n{level + 1} AS MATERIALIZED (
    SELECT n.share, n.t, rid, x, 2 * n.node + 1 + CASE WHEN x[v.i + 1] > cut THEN 1 ELSE 0 END AS node,
      coalesce(stopped, CASE WHEN v IS NULL THEN {level} END) AS stopped
    FROM n{level} n LEFT JOIN g{level} g ON g.share = n.share AND g.t = n.t AND g.node = n.node
  )"""
        )
    mean_path = "CASE n WHEN 1 THEN 0.0 WHEN 2 THEN 1.0 ELSE round((2.0 * (ln(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n) * 1048576) / 1048576 END"
    splits = " UNION ALL ".join(f"SELECT share, t, node, v.i AS i, cut FROM g{level}" for level in range(FOREST_DEPTH))
    steps.append(
        f"""
  splits AS MATERIALIZED ({splits}),
  leaves AS MATERIALIZED (
    SELECT share, t, node, stopped + {mean_path} AS path
    FROM (SELECT share, t, node, any_value(coalesce(stopped, {FOREST_DEPTH})) AS stopped, count(*) AS n FROM n{FOREST_DEPTH} GROUP BY share, t, node)
  ),
  w0 AS (SELECT rid, x, share, t, 0 AS node FROM rows, settings, (SELECT unnest(range({FOREST_TREES})) AS t))"""
    )
    for level in range(FOREST_DEPTH):
        steps.append(
            f"""
  w{level + 1} AS (
    SELECT rid, x, w.share, w.t, 2 * w.node + 1 + CASE WHEN x[s.i + 1] > cut THEN 1 ELSE 0 END AS node
    FROM w{level} w LEFT JOIN splits s ON s.share = w.share AND s.t = w.t AND s.node = w.node
  )"""
        )
    normal = f"(SELECT {mean_path} FROM (SELECT {FOREST_SIZE} AS n))"
    steps.append(
        f"""
  walked AS MATERIALIZED (
    SELECT rid, w.share, pow(2.0, -(sum(coalesce(path, {float(FOREST_DEPTH)})) / {float(FOREST_TREES)}) / {normal}) AS raw_score
    FROM w{FOREST_DEPTH} w LEFT JOIN leaves l ON l.share = w.share AND l.t = w.t AND l.node = w.node GROUP BY rid, w.share
  ),
  forest AS MATERIALIZED (SELECT rows.*, walked.share, raw_score FROM rows JOIN walked USING (rid))"""
    )
    return ",".join(steps)


def _levelled(contamination: float, source: str = "forest") -> str:
    """CTEs that level the scores of one forest."""
    return f"""
  cuts AS (SELECT quantile_cont(raw_score, 0.75) AS m, quantile_cont(raw_score, 0.95) AS h,
    quantile_cont(raw_score, {1.0 - contamination!r}) AS a FROM {source}),
  levelled AS (
    SELECT *, raw_score - a AS risk_score, a - raw_score AS anomaly_score, CASE WHEN raw_score > a THEN -1 ELSE 1 END AS anomaly,
      CASE WHEN raw_score < m THEN 'Low' WHEN raw_score < h THEN 'Medium' ELSE 'High' END AS risk_level
    FROM {source}, cuts
  )"""


GRID_CONTAMINATION, GRID_SHARES = (0.01, 0.015, 0.02, 0.025, 0.03), (0.5, 0.75, 1.0)


def _grid() -> str:
    """CTEs down to ``grid``, one row per point."""
    offsets = " UNION ALL ".join(
        f"SELECT share, {c!r}::DOUBLE AS contamination, quantile_cont(raw_score, {1.0 - c!r}) AS a, "
        "quantile_cont(raw_score, 0.75) AS m, quantile_cont(raw_score, 0.95) AS h FROM forest GROUP BY share"
        for c in GRID_CONTAMINATION
    )
    return f"""{_forest(GRID_SHARES)},
  offsets AS MATERIALIZED ({offsets}),
  grid AS MATERIALIZED (
    SELECT contamination, share / 1000.0 AS max_features, round(stddev_pop(raw_score), 6) + 0.0 AS score_std,
      round(stddev_pop(raw_score), 9) AS spread, round(avg(raw_score) - any_value(a), 6) + 0.0 AS score_mean,
      count(*) FILTER (raw_score > a) AS anomaly_count, count(*) FILTER (raw_score >= h) AS high_risk_count,
      count(*) FILTER (raw_score >= m AND raw_score < h) AS medium_risk_count, any_value(a) AS a, any_value(m) AS m, any_value(h) AS h
    FROM forest JOIN offsets USING (share) GROUP BY contamination, share
  )"""


GRID_COLUMNS = "contamination, max_features, score_std, score_mean, anomaly_count, high_risk_count, medium_risk_count"
BEST = "SELECT * FROM grid ORDER BY spread DESC, contamination, max_features LIMIT 1"


def _pivot(value: str) -> str:
    columns = ", ".join(f"any_value({value}) FILTER (max_features = {s}) AS max_features_{round(s * 100):03d}" for s in GRID_SHARES)
    return f"SELECT contamination, {columns} FROM grid GROUP BY contamination ORDER BY contamination"


def _forest_queries() -> dict[str, str]:
    single = f"{_forest((1.0,))}, {_levelled(0.02)}"
    tuned = f"""{_grid()},
  levelled AS (
    SELECT forest.*, raw_score - a AS risk_score, CASE WHEN raw_score < m THEN 'Low' WHEN raw_score < h THEN 'Medium' ELSE 'High' END AS risk_level
    FROM forest JOIN ({BEST}) best ON forest.share = best.max_features * 1000
  )"""
    return {
        "iforest_scores": _with(single, f'SELECT "user", date, anomaly, {_six("anomaly_score", "risk_score")}, risk_level FROM levelled'),
        "anomaly_counts": _with(single, "SELECT anomaly, count(*) AS count FROM levelled GROUP BY anomaly"),
        "grid_summary": _with(_grid(), f"SELECT {GRID_COLUMNS} FROM grid"),
        "grid_pivot_std": _with(_grid(), _pivot("score_std")),
        "grid_pivot_anomalies": _with(_grid(), _pivot("anomaly_count")),
        "best_config": _with(_grid(), f"SELECT {GRID_COLUMNS} FROM ({BEST})"),
        "tuned_risk_export": _with(tuned, f'SELECT "user", date, {FEATURE_LIST}, {SCORE}, risk_level FROM levelled'),
    }


def _running() -> str:
    """Each day against the user's days up to it, for days whose end the watermark has passed."""
    past = 'OVER (PARTITION BY "user" ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)'
    spikes = ", ".join(
        f"round(({c} - avg({c}) {past}) / nullif(stddev_samp({c}) {past}, 0), 6) + 0.0 AS {s}" for s, c in zip(SPIKES, MEASURES, strict=True)
    )
    rolling = 'avg(logon_count) OVER (PARTITION BY "user" ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)'
    return f"""SELECT "user", date, {", ".join(MEASURES)}, {spikes}, round({rolling}, 6) + 0.0 AS logon_rolling_3,
      round(logon_count - {rolling}, 6) + 0.0 AS logon_delta, count(*) {past} AS days
    FROM activity QUALIFY date + INTERVAL 1 DAY <= (SELECT max(ts) FROM events
      WHERE user_id IS NOT NULL AND event_type IN ('signup', 'error', 'view', 'click', 'purchase')) - INTERVAL 1 DAY"""


def oracle_queries() -> dict[str, str]:
    hour, day = _risk("hour"), _risk("day")
    activity = _activity("hour")
    scored_rows = f'SELECT "user", date, {SCORE}, risk_level FROM risk'
    weekday_name = (
        ", CASE weekday WHEN 0 THEN 'Monday' WHEN 1 THEN 'Tuesday' WHEN 2 THEN 'Wednesday' WHEN 3 THEN 'Thursday' "
        "WHEN 4 THEN 'Friday' WHEN 5 THEN 'Saturday' WHEN 6 THEN 'Sunday' END AS weekday_name"
    )
    hours = ", ".join(f"count(*) FILTER (WHERE hour = {h}) AS h{h:02d}" for h in range(24))
    levels = "(VALUES ('Low', 1), ('Medium', 2), ('High', 3)) AS spine(risk_level, place)"
    return {
        "logon_daily": _source(LOGON, "day", "count(event_type) AS logon_count"),
        "http_daily": "SELECT * REPLACE (round(http_bytes_sent, 6) + 0.0 AS http_bytes_sent) "
        f"FROM ({_source(HTTP, 'day', BYTES)})",
        "device_daily": _source(DEVICE, "day", "count(event_type) AS device_activity_count"),
        "merged_activity": _with(activity, f"SELECT * REPLACE ({_six('http_bytes_sent')}) FROM activity"),
        "merged_activity_join": _with(activity, f"SELECT * REPLACE ({_six('http_bytes_sent')}) FROM activity"),
        "calendar_features": _with(activity, f'SELECT "user", date, {CALENDAR} FROM activity'),
        "user_baseline": _with(
            _features("hour"), 'SELECT "user", ' + _six(*(f"{c}_{s}" for c in MEASURES for s in ("mean", "std"))) + " FROM baseline"
        ),
        "user_spikes": _with(_features("hour"), f'SELECT "user", date, {_six(*SPIKES)} FROM features'),
        "raw_grain_history": _with(
            _features("raw"), f'SELECT "user", date, {_six(*SPIKES, "logon_rolling_3", "logon_delta")} FROM features'
        ),
        "activity_ratios": _with(
            _features("hour"), f'SELECT "user", date, {_six("device_http_ratio", "logon_http_ratio")} FROM features'
        ),
        "missing_flags": _with(
            activity,
            'SELECT "user", date, CAST(http_requests = 0 AS INTEGER) AS http_missing, '
            "CAST(device_activity_count = 0 AS INTEGER) AS device_missing, "
            "CAST(logon_count = 0 AS INTEGER) AS logon_missing FROM activity",
        ),
        "logon_rolling": _with(
            _features("day"), f'SELECT "user", date, logon_count, {_six("logon_rolling_3", "logon_delta")} FROM features'
        ),
        "feature_matrix": _with(_features("hour"), f"SELECT {FEATURE_LIST} FROM features"),
        "scaled_features": _with(_features("hour"), _scaled()),
        "zscore_scores": _with(hour, f'SELECT "user", date, {SCORE}, risk_level FROM scored_levels'),
        "risk_thresholds": _with(hour, f"SELECT {_six('medium_from', 'high_from')} FROM cuts"),
        "risk_export": _with(hour, f'SELECT "user", date, {FEATURE_LIST}, {SCORE}, risk_level FROM scored_levels'),
        "risk_level_counts": _with(
            hour, "SELECT risk_level, count(*) AS count FROM risk GROUP BY risk_level ORDER BY count DESC"
        ),
        "zscore_anomaly_counts": _with(hour, "SELECT anomaly, count(*) AS count FROM risk GROUP BY anomaly"),
        "top5_high_risk": _with(
            hour,
            f'SELECT "user", date, {SCORE}, risk_level FROM scored_levels AS s WHERE risk_level = \'High\' '
            'ORDER BY s.risk_score DESC, "user", date LIMIT 5',
        ),
        "as_date": _with(hour, 'SELECT "user", date, risk_level FROM risk'),
        "filter_date_range": _with(hour, f"{scored_rows} WHERE {IN_RANGE}"),
        "filter_users": _with(hour, f'{scored_rows} WHERE "user" IN ({TOP_USERS})'),
        "filter_risk_levels": _with(hour, f"{scored_rows} WHERE risk_level IN ('High', 'Medium')"),
        "filter_spikes": _with(
            hour, f'SELECT "user", date, {_six("device_spike")}, risk_level FROM risk AS r WHERE r.device_spike > 2'
        ),
        "filter_activity_type": _with(
            hour,
            f'SELECT "user", date, {", ".join(MEASURES)}, risk_level FROM risk '
            "WHERE logon_count > 0 OR device_activity_count > 0",
        ),
        "filter_combined": _with(
            hour,
            f'SELECT "user", date, {", ".join(MEASURES)}, {_six("device_spike", "risk_score")}, risk_level '
            f"FROM risk AS r WHERE {IN_RANGE} AND \"user\" IN ({TOP_USERS}) AND risk_level IN ('High', 'Medium') "
            "AND r.device_spike > 1 AND device_activity_count > 0",
        ),
        "filtered_export": _with(hour, f'SELECT "user", date, {FEATURE_LIST}, {SCORE}, risk_level FROM risk WHERE {IN_RANGE}'),
        "date_bounds": _with(
            activity, "SELECT CAST(min(date) AS DATE) AS min_date, CAST(max(date) AS DATE) AS max_date FROM activity"
        ),
        "user_picker": _with(
            activity,
            f'SELECT DISTINCT "user" FROM activity WHERE CAST(date AS DATE) BETWEEN {START} AND {END} ORDER BY "user"',
        ),
        "kpis": _with(
            hour,
            'SELECT count(*) AS filtered_rows, count(DISTINCT "user") AS total_unique_users, '
            "CAST(sum(CASE WHEN risk_level = 'High' THEN 1 ELSE 0 END) AS BIGINT) AS total_high_risk_events, "
            "round(avg(risk_score), 6) AS avg_risk_score, "
            f"strftime({START}, '%Y-%m') AS range_start, strftime({END}, '%Y-%m') AS range_end FROM risk WHERE {IN_RANGE}",
        ),
        "kpi_texts": _with(
            hour,
            "SELECT format('{:,}', count(*)) AS filtered_rows, "
            "format('{:,}', count(DISTINCT \"user\")) AS total_unique_users, "
            "format('{:,}', count(*) FILTER (WHERE risk_level = 'High')) AS total_high_risk_events, "
            "printf('%.2f', avg(risk_score)) AS avg_risk_score, "
            f"strftime({START}, '%Y-%m') || ' to ' || strftime({END}, '%Y-%m') AS data_range "
            f"FROM risk WHERE {IN_RANGE}",
        ),
        "kpis_extended": _with(
            hour,
            "SELECT count(*) FILTER (WHERE anomaly = -1) AS total_anomalies, "
            "count(DISTINCT CASE WHEN risk_level = 'High' THEN \"user\" END) AS high_risk_users, "
            f"CAST(sum({' + '.join(MEASURES)}) AS BIGINT) AS activity_count FROM risk WHERE {IN_RANGE}",
        ),
        "risk_level_distribution": _with(
            hour,
            f"SELECT risk_level, coalesce(n, 0) AS count FROM {levels} LEFT JOIN (SELECT risk_level, count(*) AS n "
            f"FROM risk WHERE {IN_RANGE} GROUP BY risk_level) USING (risk_level) ORDER BY place",
        ),
        "high_risk_daily": _with(hour, _high_per("date")),
        "top_users_high_risk": _with(
            hour,
            'SELECT "user", count(*) AS high_risk_events FROM risk WHERE risk_level = \'High\' GROUP BY "user" '
            'ORDER BY high_risk_events DESC, "user" LIMIT 10',
        ),
        "risk_score_histogram": _with(hour, _histogram()),
        "flagged_events": _with(
            hour,
            f'SELECT date, "user", risk_level, {SCORE}, {", ".join(MEASURES)}, {_six(*SPIKES)}, hour, weekday '
            "FROM risk AS r WHERE risk_level IN ('High', 'Medium') "
            'ORDER BY r.risk_score DESC, "user", date, hour LIMIT 1000',
        ),
        "daily_activity_trend": _with(
            day,
            "SELECT date, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in MEASURES)
            + " FROM risk GROUP BY date ORDER BY date",
        ),
        "high_risk_by_hour": _with(hour, _high_per("hour")),
        "high_risk_by_weekday": _with(hour, _high_per("weekday", weekday_name)),
        "high_risk_heatmap": _with(
            hour, f"SELECT weekday, {hours} FROM risk WHERE risk_level = 'High' GROUP BY weekday ORDER BY weekday"
        ),
        "stream_daily_activity": _with(
            _activity("day"), f"SELECT * REPLACE ({_six('http_bytes_sent')}) FROM activity"
        ),
        "stream_scored_activity": _with(
            day,
            f'SELECT "user", date, {", ".join(MEASURES)}, {SCORE}, risk_level FROM scored_levels',
        ),
        "zscore_anomaly_score": _with(hour, 'SELECT "user", date, round(-risk_score, 6) + 0.0 AS anomaly_score FROM scored_levels'),
        "filter_spikes_all": _with(
            hour,
            f'SELECT "user", date, {_six("logon_spike", "http_spike")}, risk_level FROM risk AS r '
            "WHERE r.logon_spike > 0.5 AND r.http_spike > 0.5",
        ),
        "filter_spikes_exact": _with(hour, 'SELECT "user", date, risk_level FROM risk WHERE logon_spike = 1'),
        "filter_user_list": _with(hour, f'{scored_rows} WHERE "user" BETWEEN 1 AND 39'),
        "filter_open_range": _with(hour, f"{scored_rows} WHERE date <= {END}"),
        "kpi_texts_empty": "SELECT '0' AS filtered_rows, '0' AS total_unique_users, '0' AS total_high_risk_events, "
        "NULL::VARCHAR AS avg_risk_score, '2199-01 to 2199-01' AS data_range",
        "csv_logs_activity": _with(activity, f"SELECT * REPLACE ({_six('http_bytes_sent')}) FROM activity"),
        "rejected_rows": REJECTED,
        "csv_export_round_trip": _with(hour, f'SELECT "user", date, {FEATURE_LIST}, {SCORE}, risk_level FROM scored_levels'),
        "stored_table_report": _with(hour, f"{scored_rows} WHERE {IN_RANGE} AND risk_level <> 'Low'"),
        "mixed_format_logs": _with(activity, f"SELECT * REPLACE ({_six('http_bytes_sent')}) FROM activity"),
        "ordered_export": _with(hour, f'SELECT "user", date, {SCORE}, risk_level, row_number() OVER (ORDER BY "user", date) AS row_no FROM scored_levels'),
        "user_drilldown": _with(hour, f'{scored_rows} WHERE "user" IN ({TOP_USERS})'),
        "distinct_users_by_range": _with(hour, " UNION ALL ".join(
            f"SELECT '{label}' AS label, count(DISTINCT \"user\") AS total_unique_users, "
            f"count(DISTINCT CASE WHEN risk_level = 'High' THEN \"user\" END) AS high_risk_users FROM risk WHERE {kept}"
            for label, kept in (("all", "true"), ("fortnight", IN_RANGE), ("day", f"date = {START}"))
        )),
        "incremental_activity": _with(activity, f"SELECT * REPLACE ({_six('http_bytes_sent')}) FROM activity"),
        "refreshed_thresholds": _with(
            hour, f"SELECT {_six('medium_from', 'high_from', 'anomaly_from')}, (SELECT count(*) FROM scored) AS rows FROM cuts"
        ),
        "stream_user_history": _with(_activity("day"), _running()),
        "stream_late_rows": _with(_activity("day"), f"SELECT * REPLACE ({_six('http_bytes_sent')}) FROM activity"),
        "kmeans_scores": _kmeans(),
        **_forest_queries(),
    }
