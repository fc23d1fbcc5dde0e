"""The twelve column types: Arrow type at the edges, Spark type in the store, range, and strict JSON rule."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import types as T

from quern.errors import SegmentError


@dataclass(frozen=True)
class DType:
    name: str
    arrow: pa.DataType
    spark: T.DataType
    #: What Arrow data is cast to before Spark sees it; Spark has no unsigned types.
    carrier: pa.DataType
    low: int | None = None
    high: int | None = None

    @property
    def is_wider(self) -> bool:
        """Whether the store's type holds values that this one does not."""
        return self.arrow != self.carrier

    def from_json(self, value):
        """``value`` as this type takes it from JSON, or SegmentError: no conversion between kinds, no wrapping."""
        if value is None:
            return None
        kind = type(value)
        if self.name == "utf8" and kind is str:
            return value
        if self.name == "bool" and kind is bool:
            return value
        if self.low is not None and kind is int and self.low <= value <= self.high:
            return value
        if pa.types.is_floating(self.arrow) and kind in (int, float):
            try:
                out = float(value)
            except OverflowError:
                out = math.inf
            if math.isfinite(out):
                return out
        raise SegmentError(f"{value!r} is no {self.name}")


def _integer(bits: int, signed: bool, spark: T.DataType, carrier: pa.DataType) -> DType:
    name = f"{'' if signed else 'u'}int{bits}"
    low = -(2 ** (bits - 1)) if signed else 0
    return DType(name, getattr(pa, name)(), spark, carrier, low, low + 2**bits - 1)


DTYPES: dict[str, DType] = {
    d.name: d
    for d in (
        DType("utf8", pa.string(), T.StringType(), pa.string()),
        DType("bool", pa.bool_(), T.BooleanType(), pa.bool_()),
        _integer(8, True, T.ByteType(), pa.int8()),
        _integer(16, True, T.ShortType(), pa.int16()),
        _integer(32, True, T.IntegerType(), pa.int32()),
        _integer(64, True, T.LongType(), pa.int64()),
        _integer(8, False, T.ShortType(), pa.int16()),
        _integer(16, False, T.IntegerType(), pa.int32()),
        _integer(32, False, T.LongType(), pa.int64()),
        _integer(64, False, T.DecimalType(20, 0), pa.decimal128(20, 0)),
        DType("float32", pa.float32(), T.FloatType(), pa.float32()),
        DType("float64", pa.float64(), T.DoubleType(), pa.float64()),
    )
}


def dtype_of(arrow: pa.DataType) -> DType:
    """The column type of an Arrow type; only exact matches count."""
    for d in DTYPES.values():
        if d.arrow == arrow:
            return d
    raise SegmentError(f"unsupported type {arrow}")
