"""DuckDB oracle SQL for the registered queries.

Each oracle restates the reference's computation literally (four shifted
joins and a union for the weather lookup, a fan-out join + filter +
keep-first for the as-of estimate) over the same fixture views, so it is
an independent formulation of what the Spark plans compute compactly.
The driver registers only the base tables, so the fixture views are
inlined as CTEs.
"""

from __future__ import annotations

CEIL15 = "make_timestamp(epoch_us({t}) + ((900000000 - epoch_us({t}) % 900000000) % 900000000))"

FIXTURE_CTES = """
fx_labels AS (
  SELECT concat('G', user_id) AS gufi, {ceil_ts} AS timestamp, concat('A', user_id % 10) AS airport,
         min(CAST(round_even(value, 0) AS INT)) AS minutes_until_pushback
  FROM events WHERE event_type = 'purchase' GROUP BY 1, 2, 3),
fx_etd AS (
  SELECT concat('A', user_id % 10) AS airport, concat('G', user_id) AS gufi, ts AS timestamp,
         ts + to_microseconds(CAST(round_even(value * 60, 0) AS BIGINT) * 1000000) AS departure_runway_estimated_time
  FROM events WHERE event_type IN ('view', 'click')),
fx_lamp AS (
  SELECT concat('A', user_id % 10) AS airport, date_trunc('hour', ts) AS timestamp,
         date_trunc('hour', ts) + (event_id % 2 + 1) * INTERVAL 30 MINUTE AS forecast_timestamp,
         min(value) AS temperature, CAST(max(event_id % 36) * 10 AS DOUBLE) AS wind_direction, max(value) AS wind_speed,
         CASE WHEN min(event_id) % 5 = 0 THEN NULL ELSE CAST(min(event_id % 11) AS DOUBLE) END AS wind_gust,
         CAST(min(event_id % 7) AS DOUBLE) AS cloud_ceiling, CAST(min(event_id % 5) AS DOUBLE) AS visibility,
         min(concat('C', user_id % 3)) AS cloud, min(concat('L', event_id % 4)) AS lightning_prob,
         CASE WHEN bool_or(event_type = 'error') THEN 'True' ELSE 'False' END AS precip
  FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1, 2, 3),
fx_mfs AS (
  SELECT concat('A', c_custkey % 10) AS airport, concat('G', c_custkey) AS gufi,
         concat('E', c_nationkey % 3) AS aircraft_engine_class, c_mktsegment AS aircraft_type,
         CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE concat('M', c_nationkey % 5) END AS major_carrier,
         CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat('F', c_nationkey % 2) END AS flight_type,
         c_acctbal > 0 AS isdeparture
  FROM customer)""".format(ceil_ts=CEIL15.format(t="ts"))

WEATHER = "temperature, wind_speed, wind_gust, cloud_ceiling, visibility, cloud, lightning_prob, precip"
WEATHER_NULLS = ", ".join(
    f"CAST(NULL AS {ty}) AS {c}" for c, ty in [
        ("forecast_timestamp", "TIMESTAMP"), ("temperature", "DOUBLE"), ("wind_speed", "DOUBLE"),
        ("wind_gust", "DOUBLE"), ("cloud_ceiling", "DOUBLE"), ("visibility", "DOUBLE"),
        ("cloud", "VARCHAR"), ("lightning_prob", "VARCHAR"), ("precip", "VARCHAR")])


def _shifted_join(offset: int) -> str:
    return f"""
  SELECT l.gufi, l.timestamp, l.airport, l.minutes_until_pushback, w.timestamp AS issue_timestamp,
         w.forecast_timestamp, {', '.join('w.' + c.strip() for c in WEATHER.split(','))}
  FROM fx_labels l JOIN lamp30 w
    ON l.airport = w.airport AND l.timestamp = w.timestamp + INTERVAL {offset} MINUTE"""


# Literal weather lookup: four shifted inner joins, union, freshest issue
# per label, plus the labels no forecast serves.
WEATHER_CTES = f"""
lamp30 AS (
  SELECT * EXCLUDE (wind_direction) FROM fx_lamp
  WHERE forecast_timestamp = timestamp + INTERVAL 30 MINUTE),
matched AS ({' UNION ALL '.join(_shifted_join(m) for m in (30, 45, 60, 75))}),
freshest AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY airport, gufi, timestamp, minutes_until_pushback
                                 ORDER BY issue_timestamp DESC) AS rn FROM matched) WHERE rn = 1),
unmatched AS (
  SELECT l.* FROM fx_labels l LEFT JOIN (SELECT DISTINCT airport, gufi, timestamp FROM matched) m
    ON l.airport = m.airport AND l.gufi = m.gufi AND l.timestamp = m.timestamp
  WHERE m.gufi IS NULL),
pushback AS (
  SELECT gufi, timestamp, airport, minutes_until_pushback, forecast_timestamp, {WEATHER} FROM freshest
  UNION ALL
  SELECT gufi, timestamp, airport, minutes_until_pushback, {WEATHER_NULLS} FROM unmatched)"""

# Literal as-of: ceil-15 slots, keep latest per slot, fan-out join on the
# flight, keep updates not after the prediction, keep the latest slot.
ASOF_CTES = f"""
etd_slot AS (
  SELECT airport, gufi, timestamp AS update_timestamp, departure_runway_estimated_time,
         {CEIL15.format(t='timestamp')} AS rounded_timestamp FROM fx_etd),
etd_a1 AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY airport, gufi, rounded_timestamp
       ORDER BY update_timestamp DESC, departure_runway_estimated_time DESC NULLS LAST) AS rn
    FROM etd_slot) WHERE rn = 1)"""

FEATURE_CTES = f"""{WEATHER_CTES},
with_mfs AS (
  SELECT p.*, m.aircraft_engine_class, m.aircraft_type, m.major_carrier, m.flight_type
  FROM pushback p LEFT JOIN (SELECT * FROM fx_mfs WHERE isdeparture) m
    ON p.airport = m.airport AND p.gufi = m.gufi),
{ASOF_CTES},
fanned AS (
  SELECT w.*, e.update_timestamp, e.departure_runway_estimated_time, e.rounded_timestamp
  FROM with_mfs w LEFT JOIN etd_a1 e ON w.airport = e.airport AND w.gufi = e.gufi),
kept AS (SELECT * FROM fanned WHERE timestamp >= rounded_timestamp),
latest AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY airport, gufi, timestamp, minutes_until_pushback
                                 ORDER BY rounded_timestamp DESC) AS rn FROM kept) WHERE rn = 1),
features AS (
  SELECT airport, gufi, timestamp, minutes_until_pushback, {WEATHER},
         aircraft_engine_class, coalesce(aircraft_type, 'OTHER') AS aircraft_type,
         coalesce(major_carrier, 'OTHER') AS major_carrier, coalesce(flight_type, 'OTHER') AS flight_type,
         CAST(epoch_us(departure_runway_estimated_time) - epoch_us(timestamp) - 900000000 AS DOUBLE)
           / CAST(60000000 AS DOUBLE) AS benchmark_pushback,
         dayname(departure_runway_estimated_time) AS day_of_week,
         monthname(departure_runway_estimated_time) AS month,
         CAST(hour(departure_runway_estimated_time) AS INT) AS hour,
         CAST(year(departure_runway_estimated_time) AS INT) AS year
  FROM latest)"""


def with_ctes(*ctes: str, select: str) -> str:
    parts = [FIXTURE_CTES] + [c for c in ctes if c]
    return "WITH " + ",\n".join(p.strip().rstrip(",") for p in parts) + "\n" + select

# Scoring mode: every label kept; the estimate (and what derives from it)
# is null when no update precedes the prediction.
SCORING_FEATURE_CTES = FEATURE_CTES.split(",\nfeatures AS (")[0] + f""",
features AS (
  SELECT w.airport, w.gufi, w.timestamp, w.minutes_until_pushback,
         {', '.join('w.' + c.strip() for c in WEATHER.split(','))},
         w.aircraft_engine_class, coalesce(w.aircraft_type, 'OTHER') AS aircraft_type,
         coalesce(w.major_carrier, 'OTHER') AS major_carrier, coalesce(w.flight_type, 'OTHER') AS flight_type,
         CAST(epoch_us(a.departure_runway_estimated_time) - epoch_us(w.timestamp) - 900000000 AS DOUBLE)
           / CAST(60000000 AS DOUBLE) AS benchmark_pushback,
         dayname(a.departure_runway_estimated_time) AS day_of_week,
         monthname(a.departure_runway_estimated_time) AS month,
         CAST(hour(a.departure_runway_estimated_time) AS INT) AS hour,
         CAST(year(a.departure_runway_estimated_time) AS INT) AS year
  FROM with_mfs w LEFT JOIN latest a
    ON w.airport = a.airport AND w.gufi = a.gufi AND w.timestamp = a.timestamp)"""
