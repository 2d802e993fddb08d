"""Numbers as text with a fixed count of decimals, rounded by their exact binary value (ties to even) as file formats of labels expect.

Spark's format_string rounds the shortest decimal form half up (1/128 gives 0.007813 where the exact value's rounding is
0.007812), so these run in Arrow batches.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fixed(value: Column, digits: int) -> Column:
    """Null for null and NaN."""

    def run(v: pd.Series) -> pd.Series:
        return pd.Series([None if x != x else f"{x:.{digits}f}" for x in v.astype("float64").tolist()], dtype=object)

    return F.pandas_udf(run, T.StringType())(value.cast("double"))


def fixed_line(first: Column, values: list[Column], digits: int) -> Column:
    """A whole number and values after it, by blanks; null if any is null."""

    def run(head: pd.Series, rest: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else " ".join([str(int(h)), *[f"{x:.{digits}f}" for x in v]]) for h, v in zip(head, rest, strict=True)], dtype=object)

    whole = F.array(*[v.cast("double") for v in values])
    known = first.isNotNull()
    for v in values:
        known = known & v.isNotNull()
    line = F.pandas_udf(run, T.StringType())(F.coalesce(first.cast("long"), F.lit(0)), F.when(known, whole))
    return line
