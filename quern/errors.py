"""Failures by category; each knows the HTTP status and the gRPC code it travels under."""

from __future__ import annotations


class EngineError(Exception):
    status, code = 500, "INTERNAL"


class TableNotFound(EngineError):
    status, code = 404, "NOT_FOUND"


class TableAlreadyExists(EngineError):
    status, code = 409, "ALREADY_EXISTS"


class TableError(EngineError):
    """A schema or a payload that can't be right."""

    status, code = 400, "INVALID_ARGUMENT"


class SegmentError(EngineError):
    """Rows or columns that do not fit the table: unknown column, null key, another type, a value out of range."""

    status, code = 400, "INVALID_ARGUMENT"


class ArrowError(EngineError):
    """Bytes that are no Arrow or Parquet, or a request without columns."""


class StorageError(EngineError):
    """The store failed, or another writer holds it."""


class ConfigError(EngineError):
    """A configuration that can't be read."""
