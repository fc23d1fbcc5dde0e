"""Declared schemas of tables."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import types as T

from quern.errors import TableError
from quern.functions.dtypes import DTYPES, DType

TABLE_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]{0,127}")


@dataclass(frozen=True)
class ColumnSchema:
    dtype: str
    nullable: bool = True

    def __post_init__(self):
        if self.dtype not in DTYPES:
            raise TableError(f"unknown dtype {self.dtype!r}")
        if not isinstance(self.nullable, bool):
            raise TableError("nullable is true or false")

    @property
    def type(self) -> DType:
        return DTYPES[self.dtype]


@dataclass(frozen=True)
class TableSchema:
    """Key and columns, in their declared order.  The key is one of them, of dtype utf8."""

    key: str
    columns: dict[str, ColumnSchema] = field(default_factory=dict)

    def validate(self) -> TableSchema:
        if self.key not in self.columns:
            raise TableError(f"key {self.key!r} is no column")
        if self.columns[self.key].dtype != "utf8":
            raise TableError(f"key {self.key!r} must be utf8")
        for name in self.columns:
            if not name or name.startswith("__"):
                raise TableError(f"{name!r} can't name a column")
        if len({n.lower() for n in self.columns}) < len(self.columns):
            raise TableError("names of columns differ by more than case")
        return self

    @classmethod
    def from_json(cls, value) -> TableSchema:
        """From {"key": ..., "columns": {name: {"dtype": ..., "nullable": ...}}}; unknown fields of a column are errors."""
        try:
            key, columns = value["key"], value["columns"]
            made = {}
            for name, c in columns.items():
                if set(c) - {"dtype", "nullable"}:
                    raise TableError(f"unknown fields of column {name!r}: {sorted(set(c) - {'dtype', 'nullable'})}")
                made[name] = ColumnSchema(c["dtype"], c.get("nullable", True))
        except (KeyError, TypeError, AttributeError) as e:
            raise TableError(f"not a table schema: {e}") from e
        return cls(key, made)

    def to_json(self) -> dict:
        return {"key": self.key, "columns": {n: {"dtype": c.dtype, "nullable": c.nullable} for n, c in self.columns.items()}}

    def arrow(self) -> pa.Schema:
        return pa.schema([pa.field(n, c.type.arrow, c.nullable) for n, c in self.columns.items()], metadata={"key": self.key})

    def spark(self) -> T.StructType:
        return T.StructType([T.StructField(n, c.type.spark, c.nullable, {"dtype": c.dtype}) for n, c in self.columns.items()])
