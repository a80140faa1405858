"""Tables, regions and weight conventions of a contact matrix."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHROMS = T.StructType([T.StructField("chrom_id", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("length", T.IntegerType())])
BINS = T.StructType([T.StructField("bin_id", T.LongType()), T.StructField("chrom_id", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
PIXELS = T.StructType([T.StructField("bin1_id", T.LongType()), T.StructField("bin2_id", T.LongType()), T.StructField("count", T.DoubleType())])
CORE_BIN_COLUMNS = ("bin_id", "chrom_id", "start", "end")

#: Names of weight columns by how they apply.
DIVISIVE = ("VC", "INTER_VC", "GW_VC", "VC_SQRT", "KR", "INTER_KR", "GW_KR", "SCALE", "INTER_SCALE", "GW_SCALE")
MULTIPLICATIVE = ("ICE", "INTER_ICE", "GW_ICE", "weight")


class MatrixError(ValueError):
    """Input that breaks a rule of the matrix or of a call."""


def weight_is_divisive(name: str, attribute: bool | int | None = None) -> bool | None:
    """Whether counts are divided by the weights: the attribute decides, then the name; None: unknown."""
    if attribute is not None:
        return bool(attribute)
    return True if name in DIVISIVE else False if name in MULTIPLICATIVE else None


def weight_type(name: Column) -> Column:
    return F.when(name.isin(*DIVISIVE), "divisive").when(name.isin(*MULTIPLICATIVE), "multiplicative")


_REGION = re.compile(r"([^:]+)(?::(\d+)-(\d*))?", re.A)


@dataclass(frozen=True)
class Region:
    """A half-open stretch of a chromosome; open ends reach to the chromosome's own."""

    chrom: str
    start: int | None = None
    end: int | None = None

    @classmethod
    def parse(cls, text: str) -> Region:
        """chr, chr:s-e or chr:s-, without separators or units in the numbers."""
        m = _REGION.fullmatch(text.strip())
        if not m or not m[1].strip():
            raise MatrixError(f"not a region: {text!r}")
        start, end = (int(x) if x else None for x in (m[2], m[3]))
        if start is not None and end is not None and end < start:
            raise MatrixError(f"region ends before it starts: {text!r}")
        return cls(m[1].strip(), start, end)


def ceil_div(a: Column, b) -> Column:
    return F.floor((a + b - 1) / b).cast("long")


def floor_div(a: Column, b) -> Column:
    return F.floor(a / b).cast("long")
