"""Number formats of the text outputs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def g16(x: float) -> str:
    """The shortest of fixed and scientific notation with 16 significant digits; integers without a point."""
    if x != x:
        return "nan"
    if x in (float("inf"), float("-inf")):
        return "inf" if x > 0 else "-inf"
    return f"{x:.16g}"


@F.pandas_udf(T.StringType())
def _g16(v: pd.Series) -> pd.Series:
    return v.map(g16, na_action="ignore")


def format_count(c: Column) -> Column:
    """Whole counts are written in generated code; only others go through Python."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(whole, c.cast("long").cast("string")).otherwise(_g16(c))
