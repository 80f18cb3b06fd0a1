"""Error metrics.

Mean absolute error is summed in integer microseconds as DECIMAL(38,0)
(exact, order-independent, no overflow at any realistic row count) and
divided once, so every engine and partitioning gives the same double.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatecast.functions.timeops import BASELINE_LEAD_MINUTES, US_PER_MINUTE
from gatecast.operators.asof import DEP
from gatecast.schemas import LABEL


def baseline_error_us(ts: str = "timestamp", dep: str = DEP, label: str = LABEL) -> Column:
    """|label - baseline| in microseconds (bigint) for the ETD-less-15 predictor."""
    pred_us = (F.timestamp_diff("MICROSECOND", F.col(ts), F.col(dep))
               - F.lit(BASELINE_LEAD_MINUTES * US_PER_MINUTE))
    return F.abs(F.col(label).cast("bigint") * F.lit(US_PER_MINUTE) - pred_us)


def mae_from_error_us(err_us: Column) -> list[Column]:
    total = F.sum(err_us.cast("decimal(38,0)"))
    n = F.count(err_us)
    return [n.alias("n_rows"),
            (total.cast("double") / n.cast("double") / F.lit(float(US_PER_MINUTE))).alias("mae_minutes")]


def baseline_mae(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """MAE of the baseline, overall or per group."""
    err = baseline_error_us()
    rows = df.where(F.col(LABEL).isNotNull() & F.col(DEP).isNotNull())
    return (rows.groupBy(*by) if by else rows.groupBy()).agg(*mae_from_error_us(err))


def prediction_mae(df: DataFrame, prediction: str = "prediction", by: list[str] | None = None) -> DataFrame:
    """A3 for model predictions (double); used by the model paths."""
    err = F.abs(F.col(LABEL).cast("double") - F.col(prediction))
    rows = df.where(F.col(LABEL).isNotNull() & F.col(prediction).isNotNull())
    g = rows.groupBy(*by) if by else rows.groupBy()
    return g.agg(F.count(err).alias("n_rows"), F.avg(err).alias("mae_minutes"))


def label_range(df: DataFrame) -> tuple[float, float]:
    """A5: training label min and max (two scalars to the driver)."""
    r = df.agg(F.min(LABEL).alias("lo"), F.max(LABEL).alias("hi")).first()
    return r["lo"], r["hi"]
