"""Results must not depend on the session time zone (all times are NTZ)."""

import pytest

import __spark_entry__ as entry
from test_oracle import SF, _rows

ZONE_SENSITIVE = ["clean_features", "calendar_parts", "round_15min", "asof_bounded_30h",
                  "scan_csv_bz2", "filter_forecast_lead"]


@pytest.mark.parametrize("name", ZONE_SENSITIVE)
def test_same_result_in_half_hour_zone(spark, con, name):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        df = entry.queries()[name](spark, SF)
        got = _rows(df.columns, [tuple(r) for r in df.collect()])
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    res = con.execute(entry.oracle_sql()[name])
    assert got == _rows([d[0] for d in res.description], res.fetchall())
