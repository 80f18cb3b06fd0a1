"""Column lists and input schemas.

Fixed values that must equal the reference's for the same feature set
(names and order of the feature columns, the weather columns dropped by
the no-weather variant, the fill value and the airport list) are kept
together here.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values (must match the reference) -------------------------------
AIRPORTS = ["KATL", "KCLT", "KDEN", "KDFW", "KJFK", "KMEM", "KMIA", "KORD", "KPHX", "KSEA"]
LABEL = "minutes_until_pushback"
WEATHER_NUMERIC = ["temperature", "wind_speed", "wind_gust", "cloud_ceiling", "visibility"]
WEATHER_CATEGORICAL = ["cloud", "lightning_prob", "precip"]
WEATHER = WEATHER_NUMERIC + WEATHER_CATEGORICAL
FLIGHT_CATEGORICAL = ["aircraft_engine_class", "aircraft_type", "major_carrier", "flight_type"]
FILLED_WITH_OTHER = ["aircraft_type", "flight_type", "major_carrier"]
FILL_VALUE = "OTHER"
CATEGORICAL = ["cloud", "lightning_prob", "precip", "day_of_week", "month",
               "aircraft_engine_class", "flight_type", "aircraft_type", "major_carrier", "year"]
NUMERIC = ["temperature", "wind_speed", "wind_gust", "cloud_ceiling", "visibility",
           "benchmark_pushback", "hour"]
SLOT_MINUTES = 15
FORECAST_LEAD_MINUTES = 30
WEATHER_OFFSETS_MINUTES = [30, 45, 60, 75]
VISIBLE_HISTORY_HOURS = 30
BASELINE_LEAD_MINUTES = 15
SPLIT_TRAIN_PERCENT = 80
# -----------------------------------------------------------------------------

# Key columns kept beside the features (the reference drops them).
REQUEST_KEYS = ["gufi", "timestamp", "airport"]

# Output column order of the feature table (keys first, then the
# reference's clean-features order).
FEATURE_COLUMNS = (
    ["airport", "gufi", "timestamp", LABEL]
    + WEATHER
    + FLIGHT_CATEGORICAL
    + ["benchmark_pushback", "day_of_week", "month", "hour", "year"]
)

NO_WEATHER_CATEGORICAL = [c for c in CATEGORICAL if c not in WEATHER]
NO_WEATHER_NUMERIC = [c for c in NUMERIC if c not in WEATHER]

NTZ = T.TimestampNTZType()

LABELS_SCHEMA = T.StructType([
    T.StructField("gufi", T.StringType(), False),
    T.StructField("timestamp", NTZ, False),
    T.StructField("airport", T.StringType(), False),
    T.StructField(LABEL, T.IntegerType(), True),
])

ETD_SCHEMA = T.StructType([
    T.StructField("airport", T.StringType(), False),
    T.StructField("gufi", T.StringType(), False),
    T.StructField("timestamp", NTZ, False),
    T.StructField("departure_runway_estimated_time", NTZ, True),
])

LAMP_SCHEMA = T.StructType([
    T.StructField("airport", T.StringType(), False),
    T.StructField("timestamp", NTZ, False),
    T.StructField("forecast_timestamp", NTZ, False),
    T.StructField("temperature", T.DoubleType(), True),
    T.StructField("wind_direction", T.DoubleType(), True),
    T.StructField("wind_speed", T.DoubleType(), True),
    T.StructField("wind_gust", T.DoubleType(), True),
    T.StructField("cloud_ceiling", T.DoubleType(), True),
    T.StructField("visibility", T.DoubleType(), True),
    T.StructField("cloud", T.StringType(), True),
    T.StructField("lightning_prob", T.StringType(), True),
    T.StructField("precip", T.StringType(), True),
])

MFS_SCHEMA = T.StructType([
    T.StructField("airport", T.StringType(), False),
    T.StructField("gufi", T.StringType(), False),
    T.StructField("aircraft_engine_class", T.StringType(), True),
    T.StructField("aircraft_type", T.StringType(), True),
    T.StructField("major_carrier", T.StringType(), True),
    T.StructField("flight_type", T.StringType(), True),
    T.StructField("isdeparture", T.BooleanType(), True),
])

SCHEMAS = {"labels": LABELS_SCHEMA, "etd": ETD_SCHEMA, "lamp": LAMP_SCHEMA, "mfs": MFS_SCHEMA}
