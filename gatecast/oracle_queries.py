"""name -> DuckDB SQL, one per registered query that SQL can express."""

from __future__ import annotations

from gatecast.oracle import ASOF_CTES, FEATURE_CTES, WEATHER, WEATHER_CTES, with_ctes

ORACLE: dict[str, str] = {}

FEATURE_COLS = ("airport, gufi, timestamp, minutes_until_pushback, " + WEATHER +
                ", aircraft_engine_class, aircraft_type, major_carrier, flight_type, "
                "benchmark_pushback, day_of_week, month, hour, year")

ORACLE["clean_features"] = with_ctes(FEATURE_CTES, select=f"SELECT {FEATURE_COLS} FROM features")

ORACLE["weather_lookup"] = with_ctes(WEATHER_CTES, select="SELECT * FROM pushback")

ORACLE["weather_matched"] = with_ctes(WEATHER_CTES.split(",\nfreshest AS")[0],
                                      select="SELECT * FROM matched")

ORACLE["weather_unmatched"] = with_ctes(WEATHER_CTES.split(",\nfreshest AS")[0], select="""
SELECT l.* FROM fx_labels l
FULL OUTER JOIN (SELECT DISTINCT airport, gufi, timestamp, minutes_until_pushback FROM matched) m
  ON l.airport = m.airport AND l.gufi = m.gufi AND l.timestamp = m.timestamp
 AND l.minutes_until_pushback IS NOT DISTINCT FROM m.minutes_until_pushback
WHERE m.gufi IS NULL AND l.gufi IS NOT NULL""")

ORACLE["join_indicator"] = with_ctes(WEATHER_CTES.split(",\nfreshest AS")[0], select="""
SELECT coalesce(l.airport, m.airport) AS airport, coalesce(l.gufi, m.gufi) AS gufi,
       coalesce(l.timestamp, m.timestamp) AS timestamp,
       coalesce(l.minutes_until_pushback, m.minutes_until_pushback) AS minutes_until_pushback,
       CASE WHEN l.gufi IS NOT NULL AND m.gufi IS NOT NULL THEN 'both'
            WHEN l.gufi IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS _merge
FROM fx_labels l
FULL OUTER JOIN (SELECT DISTINCT airport, gufi, timestamp, minutes_until_pushback FROM matched) m
  ON l.airport = m.airport AND l.gufi = m.gufi AND l.timestamp = m.timestamp
 AND l.minutes_until_pushback IS NOT DISTINCT FROM m.minutes_until_pushback""")

ORACLE["dedupe_keep_latest"] = with_ctes(WEATHER_CTES.split(",\nunmatched AS")[0],
                                         select="SELECT * FROM freshest")

ORACLE["latest_per_slot"] = with_ctes(ASOF_CTES, select="""
SELECT airport, gufi, rounded_timestamp, update_timestamp AS timestamp, departure_runway_estimated_time
FROM etd_a1""")

_ASOF_FAN = f"""{ASOF_CTES},
fanned AS (
  SELECT l.*, e.update_timestamp, e.departure_runway_estimated_time, e.rounded_timestamp
  FROM fx_labels l LEFT JOIN etd_a1 e ON l.airport = e.airport AND l.gufi = e.gufi
  WHERE l.timestamp >= e.rounded_timestamp),
latest AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY airport, gufi, timestamp, minutes_until_pushback
                                 ORDER BY rounded_timestamp DESC) AS rn FROM fanned) WHERE rn = 1)"""

ORACLE["asof_etd"] = with_ctes(_ASOF_FAN, select="""
SELECT gufi, timestamp, airport, minutes_until_pushback, update_timestamp, departure_runway_estimated_time
FROM latest""")

ORACLE["asof_bounded_30h"] = with_ctes(_ASOF_FAN, select="""
SELECT l.gufi, l.timestamp, l.airport, l.minutes_until_pushback,
       CASE WHEN a.update_timestamp > l.timestamp - INTERVAL 30 HOUR THEN a.update_timestamp END AS update_timestamp,
       CASE WHEN a.update_timestamp > l.timestamp - INTERVAL 30 HOUR THEN a.departure_runway_estimated_time END
         AS departure_runway_estimated_time
FROM fx_labels l LEFT JOIN latest a
  ON l.airport = a.airport AND l.gufi = a.gufi AND l.timestamp = a.timestamp""")

ORACLE["left_join_metadata"] = with_ctes(select="""
SELECT l.*, m.aircraft_engine_class, m.aircraft_type, m.major_carrier, m.flight_type
FROM fx_labels l LEFT JOIN (SELECT * FROM fx_mfs WHERE isdeparture) m
  ON l.airport = m.airport AND l.gufi = m.gufi""")

_FEATURES_WITH_DEP = FEATURE_CTES.replace(
    "CAST(year(departure_runway_estimated_time) AS INT) AS year",
    "CAST(year(departure_runway_estimated_time) AS INT) AS year, departure_runway_estimated_time")
_ERR_US = ("abs(CAST(minutes_until_pushback AS BIGINT) * 60000000 - "
           "(epoch_us(departure_runway_estimated_time) - epoch_us(timestamp) - 900000000))")
_MAE = (f"count({_ERR_US}) AS n_rows, CAST(sum(CAST({_ERR_US} AS DECIMAL(38,0))) AS DOUBLE) "
        f"/ CAST(count({_ERR_US}) AS DOUBLE) / CAST(60000000 AS DOUBLE) AS mae_minutes")
_MAE_WHERE = "WHERE minutes_until_pushback IS NOT NULL AND departure_runway_estimated_time IS NOT NULL"

ORACLE["mae_global"] = with_ctes(_FEATURES_WITH_DEP, select=f"SELECT {_MAE} FROM features {_MAE_WHERE}")
ORACLE["mae_by_airport"] = with_ctes(_FEATURES_WITH_DEP,
                                     select=f"SELECT airport, {_MAE} FROM features {_MAE_WHERE} GROUP BY airport")

SPLIT_EXPR = ("CASE WHEN CAST(('0x' || substr(md5(concat_ws('|', airport, gufi, CAST(epoch_us(timestamp) AS VARCHAR))), 1, 8)) "
              "AS BIGINT) % 100 < 80 THEN 'train' ELSE 'test' END")
SPLIT_GROUPED_EXPR = ("CASE WHEN CAST(('0x' || substr(md5(gufi), 1, 8)) AS BIGINT) % 100 < 80 "
                      "THEN 'train' ELSE 'test' END")

ORACLE["mae_by_split"] = with_ctes(_FEATURES_WITH_DEP, select=f"""
SELECT split, {_MAE} FROM (SELECT *, {SPLIT_EXPR} AS split FROM features) {_MAE_WHERE} GROUP BY split""")

from gatecast.oracle import CEIL15, FIXTURE_CTES, SCORING_FEATURE_CTES  # noqa: E402

_F = with_ctes  # brevity

ORACLE["filter_departures"] = _F(select="""
SELECT airport, gufi, aircraft_engine_class, aircraft_type, major_carrier, flight_type
FROM fx_mfs WHERE isdeparture""")

ORACLE["filter_forecast_lead"] = _F(select="""
SELECT * FROM fx_lamp WHERE forecast_timestamp = timestamp + INTERVAL 30 MINUTE""")

ORACLE["filter_airport"] = _F(FEATURE_CTES, select=f"SELECT {FEATURE_COLS} FROM features WHERE airport = 'A3'")

ORACLE["project_drop"] = _F(select=f"SELECT airport, forecast_timestamp, {WEATHER} FROM fx_lamp")

ORACLE["project_positional"] = ORACLE["weather_lookup"]

ORACLE["align_schema"] = _F(FEATURE_CTES, select="""
SELECT airport, gufi, timestamp, minutes_until_pushback, aircraft_engine_class, aircraft_type,
       major_carrier, flight_type, benchmark_pushback, day_of_week, month, hour, year FROM features""")

ORACLE["ceil_15min"] = _F(select=f"""
SELECT airport, gufi, timestamp, {CEIL15.format(t='timestamp')} AS rounded_timestamp FROM fx_etd""")

ORACLE["round_15min"] = _F(select="""
SELECT airport, gufi, timestamp,
       make_timestamp(CAST(round_even(epoch_us(timestamp) / 900000000.0, 0) AS BIGINT) * 900000000) AS nearest_timestamp
FROM fx_etd""")

ORACLE["baseline_minutes"] = _F(_ASOF_FAN, select="""
SELECT airport, gufi, timestamp,
       CAST(epoch_us(departure_runway_estimated_time) - epoch_us(timestamp) - 900000000 AS DOUBLE)
         / CAST(60000000 AS DOUBLE) AS benchmark_pushback
FROM latest""")

ORACLE["calendar_parts"] = _F(select="""
SELECT airport, gufi, timestamp, dayname(departure_runway_estimated_time) AS day_of_week,
       monthname(departure_runway_estimated_time) AS month,
       CAST(hour(departure_runway_estimated_time) AS INT) AS hour,
       CAST(year(departure_runway_estimated_time) AS INT) AS year
FROM fx_etd""")

ORACLE["coerce_timestamp"] = _F(select="""
SELECT gufi, CAST(CAST(timestamp AS VARCHAR) AS TIMESTAMP) AS timestamp, airport FROM fx_labels""")

ORACLE["round_half_even"] = _F(FEATURE_CTES, select="""
SELECT airport, gufi, timestamp, CAST(round_even(benchmark_pushback, 0) AS INT) AS rounded_minutes FROM features""")

ORACLE["fill_other"] = _F(select="""
SELECT l.*, m.aircraft_engine_class, coalesce(m.aircraft_type, 'OTHER') AS aircraft_type,
       coalesce(m.major_carrier, 'OTHER') AS major_carrier, coalesce(m.flight_type, 'OTHER') AS flight_type
FROM fx_labels l LEFT JOIN (SELECT * FROM fx_mfs WHERE isdeparture) m
  ON l.airport = m.airport AND l.gufi = m.gufi""")

_ALL_FEATURES = [c.strip() for c in FEATURE_COLS.split(",")]

ORACLE["drop_null_rows"] = _F(FEATURE_CTES, select=f"""
SELECT {FEATURE_COLS} FROM features WHERE {' AND '.join(c + ' IS NOT NULL' for c in _ALL_FEATURES)}""")

ORACLE["null_profile"] = _F(FEATURE_CTES, select=" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count FROM features" for c in _ALL_FEATURES))

# The feature columns with no null at the driver's scales (weather and
# engine class have nulls: unmatched forecasts, arrivals).
ORACLE["drop_null_columns"] = _F(FEATURE_CTES, select="""
SELECT airport, gufi, timestamp, minutes_until_pushback, aircraft_type, major_carrier, flight_type,
       benchmark_pushback, day_of_week, month, hour, year FROM features""")

_WEATHER_NULL = " OR ".join(f"{c.strip()} IS NULL" for c in WEATHER.split(","))

ORACLE["row_has_null"] = _F(FEATURE_CTES, select=f"""
SELECT airport, gufi, timestamp, ({_WEATHER_NULL}) AS weather_has_null FROM features""")

_CATS = ["cloud", "lightning_prob", "precip", "day_of_week", "month", "aircraft_engine_class",
         "flight_type", "aircraft_type", "major_carrier", "year"]
_FEATURE_NULL = _WEATHER_NULL + " OR benchmark_pushback IS NULL OR hour IS NULL OR " + " OR ".join(f"{c} IS NULL" for c in _CATS)

ORACLE["batch_has_null"] = _F(SCORING_FEATURE_CTES, select=f"""
SELECT airport, gufi, timestamp,
       bool_or({_FEATURE_NULL}) OVER (PARTITION BY airport, timestamp) AS batch_has_null
FROM features""")

ORACLE["union_train_test"] = _F(FEATURE_CTES, select=f"""
SELECT * FROM (
  SELECT airport, gufi, timestamp, minutes_until_pushback, 0 AS test FROM features WHERE {SPLIT_EXPR} = 'train'
  UNION ALL
  SELECT airport, gufi, timestamp, minutes_until_pushback, 1 AS test FROM features WHERE {SPLIT_EXPR} = 'test')
WHERE test = 1""")

ORACLE["sorted_output"] = _F(FEATURE_CTES, select=f"SELECT {FEATURE_COLS} FROM features ORDER BY gufi, timestamp")

ORACLE["head_preview"] = _F(FEATURE_CTES, select="""
SELECT airport, gufi, timestamp FROM (
  SELECT airport, gufi, timestamp, row_number() OVER (PARTITION BY airport ORDER BY gufi, timestamp) AS rn
  FROM features) WHERE rn = 1""")

def _code(c: str) -> str:
    v = f"CAST({c} AS VARCHAR)"
    return (f"CAST(CASE WHEN {c} IS NULL THEN (SELECT count(DISTINCT {v}) FROM features) "
            f"ELSE dense_rank() OVER (ORDER BY {v}) - 1 END AS INT) AS {c}_code")


ORACLE["category_codes"] = _F(FEATURE_CTES, select=f"""
SELECT airport, gufi, timestamp, {', '.join(_code(c) for c in _CATS)} FROM features""")

ORACLE["one_hot"] = _F(FEATURE_CTES, select=" UNION ALL ".join(f"""
SELECT airport, gufi, timestamp, concat('{c}_', {c}) AS indicator FROM features
WHERE CAST({c} AS VARCHAR) <> (SELECT min(CAST({c} AS VARCHAR)) FROM features)""" for c in _CATS))

ORACLE["hash_split"] = _F(FEATURE_CTES, select=f"SELECT airport, gufi, timestamp, {SPLIT_EXPR} AS split FROM features")
ORACLE["hash_split_grouped"] = _F(FEATURE_CTES, select=f"""
SELECT airport, gufi, timestamp, {SPLIT_GROUPED_EXPR} AS split FROM features""")

ORACLE["clip_to_train_range"] = _F(FEATURE_CTES, select=f"""
SELECT f.airport, f.gufi, f.timestamp,
       least(greatest(f.benchmark_pushback, r.lo), r.hi) AS clipped_prediction
FROM (SELECT * FROM features WHERE {SPLIT_EXPR} = 'test') f,
     (SELECT min(minutes_until_pushback) AS lo, max(minutes_until_pushback) AS hi
      FROM features WHERE {SPLIT_EXPR} = 'train') r""")

ORACLE["features_and_label"] = _F(FEATURE_CTES, select=f"""
SELECT {FEATURE_COLS}, ({SPLIT_EXPR} = 'test') AS is_validation FROM features""")

_P_FULL = "benchmark_pushback + visibility - cloud_ceiling"
_P_NA = "benchmark_pushback - 1.0"


def _routed(flag: str) -> str:
    return f"""
       CASE WHEN benchmark_pushback IS NULL THEN 'none' WHEN {flag} THEN 'na' ELSE 'full' END AS model_variant,
       CASE WHEN benchmark_pushback IS NOT NULL THEN
         CAST(round_even(CASE WHEN {flag} THEN {_P_NA} ELSE {_P_FULL} END, 0) AS INT) END AS prediction"""


ORACLE["route_row_variant"] = _F(SCORING_FEATURE_CTES, select=f"""
SELECT airport, gufi, timestamp, weather_has_null, {_routed('weather_has_null')}
FROM (SELECT *, ({_WEATHER_NULL}) AS weather_has_null FROM features)""")

ORACLE["route_batch_variant"] = _F(SCORING_FEATURE_CTES, select=f"""
SELECT airport, gufi, timestamp, batch_has_null, {_routed('batch_has_null')}
FROM (SELECT *, bool_or({_FEATURE_NULL}) OVER (PARTITION BY airport, timestamp) AS batch_has_null
      FROM features)""")

ORACLE["attach_predictions"] = _F(SCORING_FEATURE_CTES, select=f"""
SELECT r.gufi, r.timestamp, r.airport, p.prediction AS minutes_until_pushback,
       coalesce(p.model_variant, 'none') AS model_variant
FROM fx_labels r LEFT JOIN (
  SELECT airport, gufi, timestamp, weather_has_null, {_routed('weather_has_null')}
  FROM (SELECT *, ({_WEATHER_NULL}) AS weather_has_null FROM features)) p
  ON r.airport = p.airport AND r.gufi = p.gufi AND r.timestamp = p.timestamp""")

ORACLE["scan_csv_bz2"] = _F(select="SELECT * FROM fx_etd")
ORACLE["scan_multi_airport"] = _F(select="SELECT * FROM fx_lamp")
ORACLE["sink_csv_roundtrip"] = ORACLE["attach_predictions"]
ORACLE["feature_table_cache"] = ORACLE["clean_features"]

# Repeated labels and metadata: the literal fan-out and keep-first over doubled views.
_REPEATED = FIXTURE_CTES.replace("fx_labels AS (", "fx_labels1 AS (", 1).replace("fx_mfs AS (", "fx_mfs1 AS (", 1) + """,
fx_labels AS (
  SELECT * FROM fx_labels1 UNION ALL SELECT * FROM fx_labels1 WHERE CAST(substr(gufi, 2) AS BIGINT) % 3 = 0),
fx_mfs AS (
  SELECT * FROM fx_mfs1 UNION ALL
  SELECT * REPLACE ('SECOND' AS aircraft_type, NULL AS flight_type) FROM fx_mfs1 WHERE CAST(substr(gufi, 2) AS BIGINT) % 2 = 0)"""
_BEST_METADATA = ("ORDER BY rounded_timestamp DESC, aircraft_engine_class DESC NULLS LAST, aircraft_type DESC NULLS LAST, "
                  "major_carrier DESC NULLS LAST, flight_type DESC NULLS LAST")

ORACLE["features_of_repeated_rows"] = ("WITH " + _REPEATED.strip() + "," + FEATURE_CTES.replace("ORDER BY rounded_timestamp DESC", _BEST_METADATA)
                                       + f"\nSELECT {FEATURE_COLS} FROM features")
ORACLE["requests_of_repeated_rows"] = "WITH " + _REPEATED.strip() + """
SELECT airport, gufi, timestamp, count(*) AS rows FROM fx_labels GROUP BY ALL"""

# Models: who must have a prediction follows from which airports have training rows.
_SPLIT_FEATURES = f"SELECT *, {SPLIT_EXPR} AS split, NOT ({_WEATHER_NULL}) AS complete FROM features"


def _expected(variant: str, train_only: bool, more: str = "") -> str:
    rows = "complete" if variant == "full" else "true"
    have = f"bool_or({rows} AND split = 'train') OVER (PARTITION BY airport)" if train_only else "true"
    return f"""
SELECT airport, gufi, timestamp, split, '{variant}' AS model_variant, {have} AS predicted{more.format(have=have)}
FROM ({_SPLIT_FEATURES}) WHERE {rows}"""


ORACLE["fit_gbt_validated"] = _F(FEATURE_CTES, select=_expected("full", True))
ORACLE["fit_gbt_final"] = _F(FEATURE_CTES, select=_expected("full", False))
ORACLE["fit_gbt_no_weather"] = _F(FEATURE_CTES, select=_expected("na", False))
ORACLE["fit_lasso"] = _F(FEATURE_CTES, select=_expected("full", True, ", {have} AS in_train_range"))
ORACLE["fit_random_forest"] = _F(FEATURE_CTES, select=_expected("full", True))

ORACLE["tune_random_search"] = _F(FEATURE_CTES, select=f"""
SELECT airport, variant, CAST(trial AS INT) AS trial, true AS evaluated, true AS trials_differ, true AS best_is_least,
       true AS best_is_refitted
FROM (SELECT airport, 'full' AS variant, unnest(range(25)) AS trial FROM ({_SPLIT_FEATURES}) WHERE complete GROUP BY airport
      UNION ALL SELECT airport, 'na', unnest(range(10)) FROM features GROUP BY airport)""")

_ROUNDTRIP = "SELECT airport, gufi, timestamp, model_variant, predicted, true AS same FROM ({})"
ORACLE["model_roundtrip"] = _F(FEATURE_CTES, select=" UNION ALL ".join(
    _ROUNDTRIP.format(_expected(v, True)) for v in ("full", "na")))

_TRAINED = FEATURE_CTES + f""",
trained AS (
  SELECT airport, bool_or(complete AND split = 'train') AS has_full, bool_or(split = 'train') AS has_na
  FROM ({_SPLIT_FEATURES}) GROUP BY airport)"""
_VISIBLE = "(SELECT * FROM latest WHERE update_timestamp > timestamp - INTERVAL 30 HOUR) a"
_BOUNDED = SCORING_FEATURE_CTES.split(",\nfeatures AS (")[1].replace("LEFT JOIN latest a", f"LEFT JOIN {_VISIBLE}")


def _scored(more: str = "") -> str:
    return f"""
SELECT airport, gufi, timestamp, model_variant, model_variant <> 'none' AS predicted{more} FROM (
  SELECT f.airport, f.gufi, f.timestamp,
         CASE WHEN benchmark_pushback IS NULL THEN 'none'
              WHEN NOT ({_WEATHER_NULL}) AND coalesce(has_full, false) THEN 'full'
              WHEN coalesce(has_na, false) THEN 'na' ELSE 'none' END AS model_variant
  FROM bounded f LEFT JOIN trained t USING (airport))"""


ORACLE["predict_requests"] = _F(_TRAINED + ",\nbounded AS (" + _BOUNDED, select=_scored())
ORACLE["stream_predict"] = _F(_TRAINED + ",\nbounded AS (" + _BOUNDED, select=_scored(", true AS same_as_batch"))

# Streams: what the bounded as-of join and the forecast lookup give for the same rows.
ORACLE["stream_asof"] = f"""
SELECT gufi, timestamp, airport, count(*) AS rows, update_timestamp, departure_runway_estimated_time, false AS late
FROM ({ORACLE["asof_bounded_30h"]}) GROUP BY ALL"""
ORACLE["stream_weather"] = _F(select="""
SELECT l.airport, l.timestamp, count(*) AS rows, w.issue_timestamp, w.forecast_timestamp, temperature, wind_speed, wind_gust,
       cloud_ceiling, visibility, cloud, lightning_prob, precip, false AS late
FROM fx_labels l LEFT JOIN (
  SELECT airport, timestamp AS issue_timestamp, timestamp + INTERVAL 1 MINUTE * lead_minutes AS slot, * EXCLUDE (airport, timestamp, lead_minutes),
         row_number() OVER (PARTITION BY airport, timestamp + INTERVAL 1 MINUTE * lead_minutes ORDER BY timestamp DESC) AS place
  FROM (SELECT *, unnest([30, 45, 60, 75]) AS lead_minutes FROM fx_lamp WHERE forecast_timestamp = timestamp + INTERVAL 30 MINUTE)) w
  ON w.airport = l.airport AND w.slot = l.timestamp AND w.place = 1 GROUP BY ALL""")

ORACLE["fit_boosted_patience"] = _F(FEATURE_CTES, select=f"""
SELECT airport, bool_or(split = 'test') AS judged, true AS kept_is_best, true AS stopped_in_time, true AS error_is_of_its_trees
FROM ({_SPLIT_FEATURES}) WHERE complete GROUP BY airport HAVING bool_or(split = 'train')""")
ORACLE["score_one_pass"] = ORACLE["predict_requests"]
ORACLE["tune_adaptive"] = _F(FEATURE_CTES, select=f"""
SELECT airport, 'full' AS variant, CAST(unnest(range(8)) AS INT) AS trial, true AS all_trials_differ, true AS starts_from_the_seed,
       true AS best_is_least, true AS refitted
FROM ({_SPLIT_FEATURES}) WHERE complete GROUP BY airport HAVING bool_or(split = 'train')""")

ORACLE["exact_grouped_split"] = _F(select="""
SELECT airport, l.gufi, timestamp, CASE WHEN upto * 100 <= total * 80 THEN 'train' ELSE 'test' END AS split
FROM fx_labels l JOIN (
  SELECT gufi, sum(n) OVER (ORDER BY substr(md5(gufi), 1, 16), gufi) AS upto, sum(n) OVER () AS total
  FROM (SELECT gufi, count(*) AS n FROM fx_labels GROUP BY gufi)) f ON f.gufi = l.gufi""")
_BAD_TIME = "CASE WHEN k % 7 = 0 THEN 'timestamp: not timestamp_ntz: soon' WHEN k % 11 = 0 THEN 'timestamp: not timestamp_ntz: 2024-01-01' END"
_BAD_ESTIMATE = "CASE WHEN k % 5 = 0 THEN 'departure_runway_estimated_time: not timestamp_ntz: 25:99' END"
ORACLE["scan_csv_quarantine"] = _F(select=f"""
SELECT CASE WHEN reasons = '' THEN airport END AS airport, gufi, CASE WHEN reasons = '' THEN timestamp END AS timestamp,
       CASE WHEN reasons = '' THEN departure_runway_estimated_time END AS departure_runway_estimated_time, nullif(reasons, '') AS reasons
FROM (SELECT *, concat_ws('; ', {_BAD_TIME}, {_BAD_ESTIMATE}) AS reasons FROM (SELECT *, CAST(substr(gufi, 2) AS BIGINT) AS k FROM fx_etd))""")
ORACLE["feature_table_incremental"] = ORACLE["clean_features"]
ORACLE["stream_scores"] = ORACLE["stream_predict"]  # the fixture's requests are distinct
