"""The same queries as plain SQL for an independent engine.

Every text starts with the same chain of common tables. Series operators are written over
whole stations here, without buckets, chunks or sketches.
"""

from __future__ import annotations

from skygauge.functions.aqi import (
    BAND_STEPS_PER_UNIT,
    BREAKPOINTS,
    CATEGORIES,
    LIMITS,
    NO2_UGM3_PER_PPB,
    OUT_OF_BAND,
)
from skygauge.plans.queries import AS_OF, NUDGE, STUB_BACKGROUND, STUB_COEFFICIENTS, STUB_INTERCEPT, STUB_MODELS
from skygauge.plans.reports import FORECAST_BANDS, LIVE_SOURCE, MODEL_SOURCE
from skygauge.schemas import (
    CYCLIC,
    FEATURED,
    INTERACTIONS,
    LAG_COLS,
    LAGS,
    MEASUREMENTS,
    POLLUTANTS,
    ROLL_COLS,
    ROLLS,
    WEATHER,
)
from skygauge.sources.sensor_log import EVENT_POLLUTANT


def each(template: str, names: list[str], sep: str = ", ") -> str:
    return sep.join(template.format(c=c) for c in names)


def index(v: str, pollutant: str, standard: str = "2024", kind: str = "INTEGER") -> str:
    arms = [f"WHEN {v} IS NULL THEN NULL"]
    for lo, hi, alo, ahi in BREAKPOINTS[standard, pollutant]:
        line = f"({ahi - alo}::DOUBLE / ({hi}::DOUBLE - {lo}::DOUBLE)) * ({v} - {lo}::DOUBLE) + {alo}"
        arms.append(f"WHEN {v} BETWEEN {lo}::DOUBLE AND {hi}::DOUBLE THEN round_even({line}, 0)")
    return f"CAST(CASE {' '.join(arms)} ELSE {OUT_OF_BAND} END AS {kind})"


def composite(pm2_5: str = "pm2_5", pm10: str = "pm10", no2: str = "no2") -> str:
    ppb = f"coalesce({no2} / {NO2_UGM3_PER_PPB}::DOUBLE, 0.0::DOUBLE)"
    return (
        f"greatest(coalesce({index(pm2_5, 'pm2_5')}, 0), coalesce({index(pm10, 'pm10')}, 0), "
        f"{index(ppb, 'no2')})"
    )


def label(aqi: str, field: int) -> str:
    arms = [f"WHEN {aqi} IS NULL THEN NULL"]
    arms += [f"WHEN {aqi} <= {row[0]} THEN '{row[field]}'" for row in CATEGORIES[:-1]]
    return f"CASE {' '.join(arms)} ELSE '{CATEGORIES[-1][field]}' END"


def calendar(ts: str) -> str:
    return f"""CAST(hour({ts}) AS INTEGER) AS hour, CAST(isodow({ts}) - 1 AS INTEGER) AS day_of_week,
  CAST(month({ts}) AS INTEGER) AS month,
  CASE WHEN isodow({ts}) >= 6 THEN 1 ELSE 0 END AS is_weekend,
  CASE WHEN hour({ts}) IN (7, 8, 9, 17, 18, 19) THEN 1 ELSE 0 END AS is_rush_hour"""


def cyclic(hour: str, month: str, dow: str) -> str:
    parts = []
    for name, value, period in (("hour", hour, 24), ("month", month, 12), ("dow", dow, 7)):
        for f in ("sin", "cos"):
            parts.append(f"{f}(2 * pi() * {value} / {period}) AS {name}_{f}")
    return ", ".join(parts)


INTERACTION_SQL = """pm2_5 / (pm10 + 1e-6::DOUBLE) AS pm_ratio,
  wind_speed / (pm2_5 + 1e-6::DOUBLE) AS wind_dispersion,
  temperature * humidity / 100 AS heat_humidity"""


def history(lags: list[int], rolls: list[int]) -> str:
    parts = [f"lag({c}, {k}) OVER w AS {c}_lag{k}" for k in lags for c in ("pm2_5", "aqi")]
    for n in rolls:
        frame = f"OVER (PARTITION BY station ORDER BY timestamp ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        for c in ("pm2_5", "aqi"):
            parts.append(f"CASE WHEN count({c}) {frame} = {n} THEN avg({c}) {frame} END AS {c}_roll{n}")
    return ", ".join(parts)


def _cents(event: str) -> str:
    only = f"FILTER (WHERE event_type = '{event}')"
    return f"sum(cents) {only} / (100.0::DOUBLE * count(*) {only})"


_means = ", ".join(f"{_cents(e)} AS {p}" for e, p in EVENT_POLLUTANT.items())
_pollutant_list = f"{_means}, sum(k)::DOUBLE / count(k) AS so2"
_weather_list = """min(value) AS temperature, sum(k)::DOUBLE / count(k) AS humidity,
  count(*)::DOUBLE AS wind_speed, (sum(k) % 360)::DOUBLE AS wind_dir, max(value) AS pressure"""

_last = "OVER (PARTITION BY station ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_next = "OVER (PARTITION BY station ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
_ends = each(
    f"last_value({{c}} IGNORE NULLS) {_last} AS lv_{{c}}, "
    f"last_value(CASE WHEN {{c}} IS NOT NULL THEN pos END IGNORE NULLS) {_last} AS lp_{{c}}, "
    f"first_value({{c}} IGNORE NULLS) {_next} AS rv_{{c}}, "
    f"first_value(CASE WHEN {{c}} IS NOT NULL THEN pos END IGNORE NULLS) {_next} AS rp_{{c}}",
    MEASUREMENTS,
)
_blend = each(
    "CASE WHEN {c} IS NOT NULL THEN {c} WHEN rp_{c} IS NULL THEN lv_{c} "
    "ELSE (rv_{c} - lv_{c}) / (rp_{c} - lp_{c}) * (pos - lp_{c}) + lv_{c} END AS {c}",
    MEASUREMENTS,
)

COMMON = f"""
ev AS (
  SELECT 'S' || (user_id // 40) AS station, date_trunc('hour', ts) AS timestamp, event_type, value,
    CAST(round(value * 100) AS BIGINT) AS cents, CAST(json_extract(props, '$.k') AS BIGINT) AS k
  FROM events),
pollutants AS (SELECT station, timestamp, {_pollutant_list} FROM ev GROUP BY station, timestamp),
weather AS (
  SELECT station, timestamp, {_weather_list} FROM ev WHERE hour(timestamp) <> 3
  GROUP BY station, timestamp),
cuts AS (SELECT station, max(timestamp) - INTERVAL 3 DAY AS cut FROM pollutants GROUP BY station),
historical AS (
  SELECT station, timestamp, {each('{c}', MEASUREMENTS)}, false AS is_forecast
  FROM pollutants JOIN cuts USING (station) JOIN weather USING (station, timestamp)
  WHERE timestamp <= cut),
ahead AS (
  SELECT station, timestamp, {each('{c}', POLLUTANTS)}, {each('NULL::DOUBLE AS {c}', WEATHER)},
    true AS is_forecast
  FROM pollutants JOIN cuts USING (station) WHERE timestamp > cut - INTERVAL 1 DAY),
combined AS (
  SELECT * EXCLUDE (choice) FROM (
    SELECT *, row_number() OVER (PARTITION BY station, timestamp ORDER BY is_forecast) AS choice
    FROM (SELECT * FROM historical UNION ALL SELECT * FROM ahead))
  WHERE choice = 1),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY station ORDER BY timestamp) - 1 AS pos,
    count(*) OVER (PARTITION BY station) AS n_rows
  FROM historical),
ends AS (SELECT *, {_ends} FROM numbered),
series AS (SELECT station, timestamp, {_blend}, is_forecast, pos, n_rows FROM ends),
medians AS (SELECT station, {each('quantile_cont({c}, 0.5) AS m_{c}', MEASUREMENTS)} FROM series GROUP BY station),
filled AS (
  SELECT station, timestamp, {each('coalesce({c}, m_{c}) AS {c}', MEASUREMENTS)}, is_forecast, pos, n_rows
  FROM series JOIN medians USING (station)),
caps AS (
  SELECT station, {each('quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}', MEASUREMENTS)}
  FROM filled GROUP BY station),
clipped AS (
  SELECT station, timestamp, {each('least(greatest({c}, lo_{c}), hi_{c}) AS {c}', MEASUREMENTS)},
    is_forecast, pos, n_rows
  FROM filled JOIN caps USING (station)),
indexed AS (SELECT *, {composite()} AS aqi, {calendar('timestamp')} FROM clipped),
wide AS (
  SELECT *, {cyclic('hour', 'month', 'day_of_week')}, {history(LAGS, ROLLS)}, {INTERACTION_SQL}
  FROM indexed WINDOW w AS (PARTITION BY station ORDER BY timestamp)),
featured AS (
  SELECT {each('{c}', FEATURED.names)} FROM wide
  WHERE {each('{c} IS NOT NULL', MEASUREMENTS + LAG_COLS + ROLL_COLS, ' AND ')}),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY station ORDER BY timestamp) - 1 AS pos,
    count(*) OVER (PARTITION BY station) AS n_rows
  FROM featured),
split AS (SELECT *, pos < floor(n_rows * 0.8::DOUBLE) AS is_train FROM placed),
origins AS (
  SELECT *, CASE WHEN pos < n_rows - 72 THEN 72 WHEN pos < n_rows - 48 THEN 48
    WHEN pos < n_rows - 24 THEN 24 ELSE 0 END AS reach
  FROM (SELECT *, pos - CAST(floor(n_rows * 0.8::DOUBLE) AS BIGINT) AS past FROM placed)
  WHERE past >= 0 AND past % 10 = 0 AND past < 500 AND pos < n_rows - 24),
latest AS (
  SELECT * EXCLUDE (back) FROM (
    SELECT *, row_number() OVER (PARTITION BY station ORDER BY timestamp DESC) AS back FROM featured)
  WHERE back = 1),
live AS (
  SELECT station, date_trunc('second', ts) AS timestamp, 'sensor ' || user_id AS station_name,
    CAST(k AS INTEGER) AS aqi_live, value AS pm25_live,
    CASE WHEN k > 50 THEN value ELSE 0.0::DOUBLE END AS temperature, 0.0::DOUBLE AS humidity,
    0.0::DOUBLE AS pressure, 0.0::DOUBLE AS wind_speed, 0.0::DOUBLE AS dew, '{LIVE_SOURCE}' AS source
  FROM (SELECT 'S' || (user_id // 40) AS station, ts, user_id, value, event_type,
          CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
  WHERE k NOT IN (0, 1)),
stub_metrics AS (
  SELECT model, ordinal, avg(abs(pm2_5 - prediction)) AS mae,
    sqrt(avg((pm2_5 - prediction) * (pm2_5 - prediction))) AS rmse,
    1 - sum((pm2_5 - prediction) * (pm2_5 - prediction)) / (var_pop(pm2_5) * count(pm2_5)) AS r2
  FROM ({' UNION ALL '.join(
    f"SELECT '{name}' AS model, {i} AS ordinal, pm2_5, {c} AS prediction FROM split WHERE NOT is_train"
    for i, (name, c) in enumerate(STUB_MODELS.items()))})
  GROUP BY model, ordinal)"""


def sql(body: str, *extra: str) -> str:
    return "WITH RECURSIVE " + ", ".join([COMMON.strip(), *extra]) + "\n" + body.strip()


def r6(names: list[str]) -> str:
    # Adding zero turns a rounded -0.0 into 0.0.
    return each(f"round({{c}} + {NUDGE}::DOUBLE, 6) + 0.0::DOUBLE AS {{c}}", names)


# -- recursive forecast -----------------------------------------------------------------


def _stub_prediction() -> str:
    """Prediction of the next step from a row with ``values`` (origin first) and ``s``."""

    def lag(n: int) -> str:
        return f"(CASE WHEN s >= {n} THEN p.values[s - {n} + 1] ELSE p.pm2_5_lag{n} END)"

    def roll(n: int) -> str:
        return f"list_avg(list_slice(p.values, greatest(1, s - {n} + 1), s))"

    hour, dow = "((p.hour + s) % 24)", "((p.day_of_week + s // 24) % 7)"
    terms = {
        "pm2_5_lag1": lag(1),
        "pm2_5_lag24": lag(24),
        "pm2_5_roll3": roll(3),
        "pm2_5_roll24": roll(24),
        "aqi_lag6": index(lag(6), "pm2_5", "2012", "DOUBLE"),
        "aqi_roll12": index(roll(12), "pm2_5", "2012", "DOUBLE"),
        "hour_sin": f"sin(2 * pi() * {hour} / 24)",
        "dow_cos": f"cos(2 * pi() * {dow} / 7)",
        "is_rush_hour": f"(CASE WHEN {hour} IN (7, 8, 9, 17, 18, 19) THEN 1 ELSE 0 END)",
        "is_weekend": f"(CASE WHEN {dow} IN (5, 6) THEN 1 ELSE 0 END)",
        "pm_ratio": f"({lag(1)} / ((CASE WHEN p.pm10 > 0 THEN p.pm10 ELSE 1 END) + 1e-6::DOUBLE))",
        "heat_humidity": "(p.temperature * p.humidity / 100)",
        "wind_speed": "p.wind_speed",
    }
    total = " + ".join(f"{STUB_COEFFICIENTS[f]}::DOUBLE * {e}" for f, e in terms.items())
    return f"greatest(0.0::DOUBLE, {STUB_INTERCEPT}::DOUBLE + {total})"


_STATE = ["station", "timestamp", "hour", "day_of_week", "pm10", "temperature", "humidity", "wind_speed"]
_STATE += [f"pm2_5_lag{k}" for k in LAGS]


def _paths(source: str, keep: tuple[str, ...] = ()) -> str:
    cols = each("p.{c}", [*_STATE, *keep])
    return f"""paths AS (
  SELECT {each('{c}', [*_STATE, *keep])}, 1 AS s, [pm2_5] AS values FROM {source}
  UNION ALL
  SELECT {cols}, s + 1, list_append(p.values, {_stub_prediction()}) FROM paths p WHERE s <= 72),
predicted AS (
  SELECT {each('{c}', ['station', 'timestamp', *keep])}, s - 1 AS horizon_hour, values[s] AS predicted
  FROM paths WHERE s > 1)"""


_FORECAST = f"""forecast AS (
  SELECT station, timestamp + to_hours(horizon_hour) AS timestamp,
    round_even(predicted, 2) AS pm2_5_predicted,
    {index('predicted', 'pm2_5', '2012', 'DOUBLE')} AS aqi_predicted,
    CAST(horizon_hour AS INTEGER) AS horizon_hour
  FROM predicted),
labelled AS (SELECT *, {label('aqi_predicted', 1)} AS aqi_category FROM forecast)"""


def forecast_sql(body: str) -> str:
    return sql(body, _paths("latest"), _FORECAST)


# -- two rounds of boosting -----------------------------------------------------------------


def _level(tree: int, level: int) -> str:
    """Best cut of each node of a level, and the rows one level further down."""
    rows = f"rows_{tree}_{level}"
    return f"""
hist_{tree}_{level} AS (
  SELECT node, f, x[f] AS v, sum(p - y) AS g, count(*) AS h FROM {rows}, unnest([1, 2, 3, 4, 5]) AS t(f)
  WHERE node >= {2**level - 1} GROUP BY ALL),
run_{tree}_{level} AS (
  SELECT node, f, v, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER (PARTITION BY node, f) AS ga, sum(h) OVER (PARTITION BY node, f) AS ha
  FROM hist_{tree}_{level} WINDOW w AS (PARTITION BY node, f ORDER BY v)),
cut_{tree}_{level} AS (
  SELECT node, f, v FROM (
    SELECT *, (gl * gl / (hl + 1) + (ga - gl) * (ga - gl) / (ha - hl + 1) - ga * ga / (ha + 1)) / 2 AS gain FROM run_{tree}_{level} WHERE ha > hl)
  WHERE gain > 1e-6 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, v) = 1),
rows_{tree}_{level + 1} AS (
  SELECT event_id, x, y, p, CASE WHEN f IS NULL THEN r.node ELSE 2 * r.node + 1 + CAST(x[f] > v AS INT) END AS node
  FROM {rows} r LEFT JOIN cut_{tree}_{level} c ON r.node = c.node)"""


def _nodes(tree: int) -> str:
    parts = [
        f"""SELECT {tree} AS tree, r.node, any_value(f) AS f, any_value(v) AS threshold, -sum(p - y) / (count(*) + 1) * 0.5::DOUBLE AS value, count(*) AS rows
  FROM rows_{tree}_{level} r {'LEFT JOIN cut_' + str(tree) + '_' + str(level) + ' c ON r.node = c.node' if level < 2 else 'CROSS JOIN (SELECT NULL AS f, NULL AS v)'}
  WHERE r.node >= {2**level - 1} GROUP BY r.node"""
        for level in range(3)
    ]
    return " UNION ALL ".join(parts)


BOOSTING_ROUNDS = f"""
WITH data AS (
  SELECT event_id, [hour(ts), isodow(ts) - 1, CAST(json_extract(props, '$.k') AS BIGINT), user_id % 40, length(event_type)] AS x,
    round(value * 100) AS y FROM events),
mean AS (SELECT avg(y) AS m FROM data),
rows_0_0 AS (SELECT event_id, x, y, round(m, CAST(9 - floor(log10(m)) AS INT)) AS p, 0 AS node FROM data, mean),
{_level(0, 0)}, {_level(0, 1)},
nodes_0 AS ({_nodes(0)}),
rows_1_0 AS (SELECT event_id, x, y, p + value AS p, 0 AS node FROM rows_0_2 JOIN nodes_0 USING (node)),
{_level(1, 0)}, {_level(1, 1)},
nodes_1 AS ({_nodes(1)})
SELECT CAST(tree AS INT) AS tree, CAST(node AS INT) AS node, ['hour', 'day', 'k', 'sensor', 'kind'][f] AS feature,
  CAST(threshold AS DOUBLE) AS threshold, round(value, 4) + 0.0::DOUBLE AS value, rows
FROM (SELECT * FROM nodes_0 UNION ALL SELECT * FROM nodes_1)"""


def _backtest(source: str) -> str:
    return f"""
SELECT label, CAST(h AS INTEGER) AS horizon_hours, round(avg(mae) + 1.7e-9, 6) AS mae, count(mae) AS n_origins
FROM (VALUES ('24hr', 24), ('48hr', 48), ('72hr', 72)) AS t(label, h)
LEFT JOIN (
  SELECT f.station, f.pos, hz.h AS served, avg(abs(a.pm2_5 - f.predicted)) AS mae
  FROM {source} f
  JOIN placed a ON a.station = f.station AND a.pos = f.pos + f.horizon_hour
  JOIN (VALUES (24), (48), (72)) AS hz(h) ON f.horizon_hour <= hz.h AND hz.h <= f.reach
  GROUP BY f.station, f.pos, hz.h) ON served = h
GROUP BY label, h"""


# -- reports ----------------------------------------------------------------------------


def _conditions(aqi: str, pm2_5: str, pick, source: str, tables: str, station: str = "f.station") -> str:
    def one(v: str) -> str:
        return f"round_even(coalesce({v}, 0.0::DOUBLE), 1)"

    def whole(v: str) -> str:
        return f"CAST(trunc(coalesce({v}, 0)) AS INTEGER)"

    return f"""
SELECT station, aqi, pm2_5, pm10, temperature, humidity, wind_speed, pressure,
  {label('aqi', 2)} AS category, {label('aqi', 3)} AS advice, {label('aqi', 4)} AS colour, source
FROM (SELECT {station} AS station, {aqi} AS aqi, {one(pm2_5)} AS pm2_5, {one('f.pm10')} AS pm10,
    {one(pick('temperature'))} AS temperature, {whole(pick('humidity'))} AS humidity,
    {one(pick('wind_speed'))} AS wind_speed, {whole(pick('pressure'))} AS pressure, {source} AS source
  FROM {tables})"""


_REPORT_AQI = f"coalesce({index('pm2_5', 'pm2_5')}, 0)"
_MODEL_AQI = f"coalesce({index('f.pm2_5', 'pm2_5')}, 0)"
_LIVE_LATEST = """live_latest AS (
  SELECT * EXCLUDE (c) FROM (SELECT *, row_number() OVER (
      PARTITION BY station ORDER BY timestamp DESC, aqi_live DESC, station_name DESC, pm25_live DESC) AS c FROM live) WHERE c = 1)"""

_band = " ".join(f"WHEN aqi_predicted <= {hi} THEN {{}}" for _, hi, _ in FORECAST_BANDS)


def _bands(field: int, quote: str = "") -> str:
    return f"CASE {_band.format(*[f'{quote}{b[field]}{quote}' for b in FORECAST_BANDS])} END"


_limits = ", ".join(f"('{p}', {v}::DOUBLE)" for p, v in LIMITS)
_levels = " UNION ALL ".join(
    f"SELECT station, '{p}' AS pollutant, round_even(coalesce({p}, 0.0::DOUBLE), 1) AS value FROM latest"
    for p, _ in LIMITS
)

_no_gaps = index("cut", "pm2_5")
_contribution = " UNION ALL ".join(
    f"SELECT station, timestamp, '{f}' AS feature, {c}::DOUBLE * ({f} - (SELECT avg({f}) FROM featured)) AS contribution FROM featured"
    for f, c in STUB_COEFFICIENTS.items()
)
_ROUNDED_FEATURES = [
    c for c in FEATURED.names if c in [*MEASUREMENTS, *CYCLIC, *ROLL_COLS, *INTERACTIONS]
    or c.startswith("pm2_5_lag")
]
_featured_out = ", ".join(
    r6([c]) if c in _ROUNDED_FEATURES else c for c in FEATURED.names
)
_quantile_rows = " UNION ALL ".join(
    f"SELECT station, '{c}' AS measure, m_{c} AS median, lo_{c} AS lower, hi_{c} AS upper "
    f"FROM medians JOIN caps USING (station)"
    for c in MEASUREMENTS
)
_steps = BAND_STEPS_PER_UNIT["pm2_5"]
_event_pollutants = ", ".join(
    f"('{e}', '{p}')" for e, p in EVENT_POLLUTANT.items() if ("2024", p) in BREAKPOINTS
)
_band_rows = ", ".join(
    f"('{p}', {lo}::DOUBLE, {hi}::DOUBLE, {alo}, {ahi})"
    for (standard, p), bands in BREAKPOINTS.items()
    if standard == "2024"
    for lo, hi, alo, ahi in bands
)
_series_out = f"station, timestamp, {r6(MEASUREMENTS)}, is_forecast, pos, n_rows"
_metric_cols = r6(["mae", "rmse", "r2"])
_best = "SELECT model FROM stub_metrics ORDER BY round_even(mae, 3), ordinal LIMIT 1"

ORACLE: dict[str, str] = {
    "hourly_readings": sql(
        f"SELECT station, timestamp, {_pollutant_list}, {_weather_list} FROM ev GROUP BY station, timestamp"
    ),
    "payload_flatten": sql("SELECT * FROM pollutants"),
    "landed_payloads": sql("SELECT *, true AS is_forecast FROM pollutants"),
    "weather_payloads": sql("SELECT * FROM weather"),
    "historical_rows": sql("SELECT * FROM combined WHERE NOT is_forecast"),
    "snapshot_overwrite": sql("SELECT * REPLACE (pm2_5 * 2 AS pm2_5) FROM historical"),
    "csv_scan": sql("SELECT * FROM historical"),
    "live_readings": sql("SELECT * FROM live"),
    "lenient_cast": """SELECT event_id,
  TRY_CAST(CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS number
FROM events""",
    "merge_weather": sql("SELECT * FROM historical"),
    "union_dedup": sql("SELECT * FROM combined"),
    "row_counts": sql(
        """SELECT count(*) FILTER (WHERE NOT is_forecast) AS historical_rows,
  count(*) FILTER (WHERE is_forecast) AS forecast_rows, count(*) AS total_rows FROM combined"""
    ),
    "trailing_range": sql(
        f"""SELECT * FROM pollutants
WHERE timestamp >= DATE '{AS_OF}' - INTERVAL 10 DAY AND timestamp < DATE '{AS_OF}'"""
    ),
    "regular_hours": sql(
        """SELECT * FROM (
  SELECT station, unnest(generate_series(min(timestamp), max(timestamp), INTERVAL 1 HOUR)) AS timestamp
  FROM pollutants GROUP BY station) LEFT JOIN pollutants USING (station, timestamp)"""
    ),
    "aqi_pm25_2024": f"""SELECT event_id, value, {index('value', 'pm2_5')} AS aqi, {_no_gaps} AS aqi_no_gaps
FROM (SELECT *, floor(round(value * {_steps}, 6)) / {_steps}::DOUBLE AS cut FROM events)""",
    "aqi_pm25_2012": f"SELECT event_id, value, {index('value', 'pm2_5', '2012', 'DOUBLE')} AS aqi FROM events",
    "aqi_pm10": f"SELECT event_id, value, {index('value', 'pm10')} AS aqi FROM events",
    "aqi_no2": f"""SELECT event_id, value, {index('value', 'no2')} AS aqi
FROM (SELECT event_id, coalesce(value / {NO2_UGM3_PER_PPB}::DOUBLE, 0) AS value FROM events)""",
    "aqi_composite": sql(
        f"SELECT station, timestamp, {composite()} AS aqi, {_REPORT_AQI} AS aqi_pm25_only FROM pollutants"
    ),
    "aqi_band_join": f"""SELECT event_id, n.pollutant, value, lo, hi,
  CASE WHEN value IS NULL THEN NULL ELSE coalesce(CAST(round_even(
    ((ahi - alo)::DOUBLE / (hi - lo)) * (value - lo) + alo, 0) AS INTEGER), {OUT_OF_BAND}) END AS sub_index
FROM events e JOIN (VALUES {_event_pollutants}) AS n(event_type, pollutant) USING (event_type)
LEFT JOIN (VALUES {_band_rows}) AS b(pollutant, lo, hi, alo, ahi)
  ON b.pollutant = n.pollutant AND value BETWEEN lo AND hi""",
    "aqi_category": sql(
        f"""SELECT station, {label('aqi', 1)} AS category, count(*) AS hours,
  min(aqi) AS aqi_min, max(aqi) AS aqi_max
FROM (SELECT station, {composite()} AS aqi FROM pollutants) GROUP BY 1, 2"""
    ),
    "interpolate": sql(f"SELECT {_series_out} FROM series"),
    "causal_series": sql(
        f"SELECT station, timestamp, {each('coalesce({c}, lv_{c}) AS {c}', MEASUREMENTS)}, is_forecast, pos, n_rows FROM ends"
    ),
    "causal_series": sql(
        f"SELECT station, timestamp, {each('coalesce({c}, lv_{c}) AS {c}', MEASUREMENTS)}, is_forecast, pos, n_rows FROM ends"
    ),
    "median_fill": sql(f"SELECT {_series_out} FROM filled"),
    "station_quantiles": sql(
        f"SELECT station, measure, {r6(['median', 'lower', 'upper'])} FROM ({_quantile_rows})"
    ),
    "percentile_clip": sql(f"SELECT {_series_out} FROM clipped"),
    "calendar_features": f"SELECT event_id, {calendar('ts')} FROM events",
    "cyclic_features": f"""SELECT event_id, {r6(CYCLIC)}
FROM (SELECT event_id, {cyclic('hour(ts)', 'month(ts)', '(isodow(ts) - 1)')} FROM events)""",
    "lag_features": sql(
        f"""SELECT station, timestamp, pm2_5, aqi, {each('{c}::DOUBLE AS {c}', LAG_COLS)} FROM (
  SELECT *, {history(LAGS, [])} FROM (SELECT *, {composite()} AS aqi FROM historical)
  WINDOW w AS (PARTITION BY station ORDER BY timestamp))"""
    ),
    "rolling_features": sql(
        f"""SELECT station, timestamp, pm2_5, aqi, {r6(ROLL_COLS)} FROM (
  SELECT *, {history([], ROLLS)} FROM (SELECT *, {composite()} AS aqi FROM historical))"""
    ),
    "interaction_features": sql(
        f"SELECT station, timestamp, {r6(INTERACTIONS)} FROM (SELECT station, timestamp, {INTERACTION_SQL} FROM historical)"
    ),
    "featured_table": sql(f"SELECT {_featured_out} FROM featured"),
    "aqi_stats": sql(
        """SELECT count(*) AS n_rows, min(aqi) AS aqi_min, max(aqi) AS aqi_max,
  round(avg(aqi) + 1.7e-9, 6) AS aqi_mean FROM featured"""
    ),
    "chrono_split": sql("SELECT station, timestamp, pos, n_rows, is_train FROM split"),
    "regression_metrics": sql(
        f"""SELECT station, {_metric_cols}, n FROM (
  SELECT station, avg(abs(pm2_5 - pm2_5_lag1)) AS mae,
    sqrt(avg((pm2_5 - pm2_5_lag1) * (pm2_5 - pm2_5_lag1))) AS rmse,
    1 - sum((pm2_5 - pm2_5_lag1) * (pm2_5 - pm2_5_lag1)) / (var_pop(pm2_5) * count(*)) AS r2, count(*) AS n
  FROM split WHERE NOT is_train GROUP BY station)"""
    ),
    "select_model": sql(
        f"SELECT model, ordinal, {_metric_cols} FROM stub_metrics WHERE model = ({_best})"
    ),
    "model_comparison": sql(
        f"""SELECT model, ordinal, round_even(mae, 3) AS mae, round_even(rmse, 3) AS rmse,
  round_even(r2, 3) AS r2, model = ({_best}) AS selected FROM stub_metrics"""
    ),
    "backtest_origins": sql("SELECT station, timestamp, pos, reach FROM origins"),
    "backtest_mae": sql(
        _backtest(
            """(SELECT station, pos, reach, pm2_5 AS predicted, unnest(range(1, 73)) AS horizon_hour
    FROM origins)"""
        )
    ),
    "recursive_forecast": forecast_sql("SELECT * FROM labelled"),
    "forecast_sample": forecast_sql("SELECT * FROM labelled WHERE (horizon_hour - 1) % 12 = 0"),
    "recursive_backtest": sql(_backtest("predicted"), _paths("origins", ("pos", "reach"))),
    "metric_history": sql(
        f"""SELECT run_id, model AS name, CAST(ordinal AS INTEGER) AS ordinal, {r6(['mae', 'rmse', 'r2'])},
  row_number() OVER (PARTITION BY run_id ORDER BY round_even(mae, 3), ordinal) = 1 AS winner, run_id = 'whole' AS latest
FROM (
  SELECT run_id, model, ordinal, avg(abs(pm2_5 - prediction)) AS mae,
    sqrt(avg((pm2_5 - prediction) * (pm2_5 - prediction))) AS rmse,
    1 - sum((pm2_5 - prediction) * (pm2_5 - prediction)) / (var_pop(pm2_5) * count(pm2_5)) AS r2
  FROM ({' UNION ALL '.join(
    f"SELECT '{run}' AS run_id, '{name}' AS model, {i} AS ordinal, pm2_5, {c} AS prediction FROM split WHERE NOT is_train{where}"
    for i, (name, c) in enumerate(STUB_MODELS.items()) for run, where in (('half', ' AND pos % 2 = 0'), ('whole', '')))})
  GROUP BY run_id, model, ordinal)"""
    ),
    "boosting_rounds": BOOSTING_ROUNDS,
    "coalition_shap": sql(
        f"""SELECT station, timestamp, feature, {r6(['contribution'])} FROM ({' UNION ALL '.join(
    f"SELECT station, timestamp, '{f}' AS feature, {c}::DOUBLE * ({f} - (SELECT avg({f}) FROM unknown)) AS contribution FROM explained"
    for f, c in STUB_COEFFICIENTS.items())})""",
        """explained AS (
  SELECT * FROM featured
  ORDER BY md5(station || '|' || strftime(timestamp, '%Y-%m-%d %H:%M:%S') || '|42'), station, timestamp LIMIT 500)""",
        f"""unknown AS (
  SELECT * FROM featured
  ORDER BY md5(station || '|' || strftime(timestamp, '%Y-%m-%d %H:%M:%S') || '|background 42'), station, timestamp LIMIT {STUB_BACKGROUND})""",
    ),
    "linear_attribution": sql(
        f"SELECT station, timestamp, feature, {r6(['contribution'])} FROM ({_contribution})"
    ),
    "importance_topk": sql(
        f"""SELECT feature, {r6(['mean_shap'])} FROM (
  SELECT feature, avg(abs(contribution)) AS mean_shap FROM ({_contribution}) GROUP BY feature)
ORDER BY mean_shap DESC, feature LIMIT 10"""
    ),
    "sampled_rows": sql(
        """SELECT station, timestamp, aqi FROM featured
ORDER BY md5(station || '|' || strftime(timestamp, '%Y-%m-%d %H:%M:%S') || '|42'), station, timestamp LIMIT 500"""
    ),
    "latest_per_station": sql(
        """SELECT * EXCLUDE (back) FROM (SELECT *, row_number() OVER (
    PARTITION BY station ORDER BY timestamp DESC) AS back FROM historical) WHERE back = 1"""
    ),
    "current_conditions": sql(
        _conditions(
            f"CASE WHEN l.station IS NOT NULL THEN l.aqi_live ELSE {_MODEL_AQI} END",
            "CASE WHEN l.station IS NOT NULL THEN l.pm25_live ELSE f.pm2_5 END",
            lambda c: f"CASE WHEN l.station IS NOT NULL THEN l.{c} ELSE f.{c} END",
            f"CASE WHEN l.station IS NOT NULL THEN '{LIVE_SOURCE}' ELSE '{MODEL_SOURCE}' END",
            "latest f FULL JOIN live_latest l ON l.station = f.station",
            "coalesce(f.station, l.station)",
        ),
        _LIVE_LATEST,
    ),
    "current_conditions_model": sql(
        _conditions(_MODEL_AQI, "f.pm2_5", lambda c: f"f.{c}", f"'{MODEL_SOURCE}'", "latest f")
    ),
    "history_7d": sql(
        f"""SELECT station, timestamp, {_REPORT_AQI} AS aqi FROM (
  SELECT *, max(timestamp) OVER (PARTITION BY station) AS last FROM featured)
WHERE timestamp >= last - INTERVAL 7 DAY"""
    ),
    "next_24h": forecast_sql(
        """SELECT station, strftime(timestamp, '%a %H:%M') AS time, CAST(trunc(aqi_predicted) AS INTEGER) AS aqi,
  round_even(pm2_5_predicted, 1) AS pm2_5, aqi_category AS category FROM labelled WHERE horizon_hour <= 24"""
    ),
    "full_72h": forecast_sql(
        """SELECT station, strftime(timestamp, '%b %d, %Y  %H:%M') AS time,
  CAST(trunc(aqi_predicted) AS INTEGER) AS aqi, round_even(pm2_5_predicted, 1) AS pm2_5,
  aqi_category AS category, horizon_hour || 'h ahead' AS horizon FROM labelled"""
    ),
    "forecast_bands": forecast_sql(
        f"""SELECT station, timestamp, horizon_hour, aqi_predicted, pm2_5_predicted,
  {_bands(0)}::DOUBLE AS band_low, {_bands(1)}::DOUBLE AS band_high, {_bands(2, "'")} AS band FROM labelled"""
    ),
    "pollutant_limits": sql(
        f"""SELECT station, pollutant, value, "limit", value > "limit" AS exceeds
FROM ({_levels}) JOIN (VALUES {_limits}) AS l(pollutant, "limit") USING (pollutant)"""
    ),
    "live_stream": sql(
        f"""SELECT station, timestamp, readings, pm2_5, {_REPORT_AQI} AS aqi, {label(_REPORT_AQI, 1)} AS category
FROM (
  SELECT station, timestamp, count(*) AS readings, sum(cents)::DOUBLE / (100 * count(*)) AS pm2_5
  FROM (SELECT DISTINCT 'S' || (user_id // 40) AS station, date_trunc('hour', ts) AS timestamp, ts, user_id,
      CAST(round(value * 100) AS BIGINT) AS cents FROM events WHERE event_type = 'click')
  GROUP BY station, timestamp)"""
    ),
}
