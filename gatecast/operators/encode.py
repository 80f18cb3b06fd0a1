"""Category codes and indicator columns.

Levels are learnt with ``StringIndexer`` (alphabetical, unseen and null
values kept in an extra slot), so only the distinct levels reach the
driver.  Indicator columns drop the first level, as pandas'
``get_dummies(drop_first=True)``; nulls become all zeros.  The lasso fit
uses the same indicators.
"""

from __future__ import annotations

from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_category_strings(df: DataFrame, cols: list[str]) -> DataFrame:
    """Categories as strings (``year`` is an int in the feature table)."""
    return df.select(*[F.col(c).cast("string").alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def category_indexer(cols: list[str], suffix: str = "_idx") -> StringIndexer:
    return StringIndexer(inputCols=cols, outputCols=[c + suffix for c in cols],
                         stringOrderType="alphabetAsc", handleInvalid="keep")


def category_codes(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None,
                   suffix: str = "_code") -> tuple[DataFrame, StringIndexerModel]:
    """Integer code per level; fit on ``fit_on`` (train) when given."""
    src = as_category_strings(df, cols)
    fit_src = as_category_strings(fit_on, cols) if fit_on is not None else src
    model = category_indexer(cols, suffix).fit(fit_src)
    out = model.transform(src)
    for c in cols:
        out = out.withColumn(c + suffix, F.col(c + suffix).cast("int"))
    return out, model


def category_levels(df: DataFrame, cols: list[str]) -> dict[str, list[str]]:
    """Alphabetical levels of each category; only distinct levels reach the driver."""
    row = as_category_strings(df, cols).agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in cols]).first()
    return {c: list(row[c]) for c in cols}


def indicators(levels: dict[str, list[str]]) -> dict[str, str]:
    """Column name -> SQL expression of the 0/1 indicator of every level but the first; null is all zeros."""
    quote = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return {f"{c}_{v}": f"CAST(coalesce(CAST(`{c}` AS STRING) = {quote(v)}, false) AS INT)"
            for c, all_levels in levels.items() for v in all_levels[1:]}


def one_hot(df: DataFrame, cols: list[str]) -> DataFrame:
    """``{col}_{level}`` 0/1 columns for every level but the first."""
    made = indicators(category_levels(df, cols))
    return df.select(*df.columns, *[F.expr(e).alias(n) for n, e in made.items()])
