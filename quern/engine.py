"""The engine: tables by name; create, write, fetch, compact."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Sequence
from dataclasses import dataclass
from enum import StrEnum

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.errors import ConfigError
from quern.functions.dtypes import DTYPES
from quern.functions.schema import ColumnSchema, TableSchema
from quern.operators import segments
from quern.operators.fetch import check_columns, fetch
from quern.sources import egress, ingest
from quern.sources.catalog import Catalog
from quern.sources.files import Files

__all__ = ["ColumnSchema", "Config", "DType", "Engine", "TableSchema", "start_local"]

#: DType.FLOAT32 and so on, for those who prefer names to strings.
DType = StrEnum("DType", {name.upper(): name for name in DTYPES})


@dataclass(frozen=True)
class Config:
    """``root``: a folder on any file system Spark reads.  ``compact_at``: segments from which a write compacts (0: never).

    ``backend``: "disk" reads segments, "memory" also keeps the latest rows of each table on the executors.
    """

    root: str
    backend: str = "disk"
    compact_at: int = 32
    write_tasks: int | None = None
    http_host: str = "127.0.0.1"
    http_port: int = 8080
    grpc_host: str = "127.0.0.1"
    grpc_port: int = 8081
    body_limit: int = 1 << 30

    @classmethod
    def load(cls, values: dict | str | None = None, env: dict | None = None) -> Config:
        """From a mapping or a TOML or JSON file, each value overridden by QUERN_<NAME> in the environment."""
        if isinstance(values, str):
            values = cls._file(values)
        values, env = dict(values or {}), os.environ if env is None else env
        for name in cls.__dataclass_fields__:
            if (v := env.get(f"QUERN_{name.upper()}")) is not None:
                values[name] = v
        try:
            for name in set(values) - TEXTS:
                values[name] = None if values[name] is None else int(values[name])
            out = cls(**values)
        except (TypeError, ValueError) as e:
            raise ConfigError(str(e)) from e
        if out.backend not in ("disk", "memory"):
            raise ConfigError(f"there is no backend {out.backend!r}")
        return out

    @staticmethod
    def _file(path: str) -> dict:
        import json
        import tomllib

        try:
            with open(path, "rb") as f:
                return json.load(f) if path.endswith(".json") else tomllib.load(f)
        except (OSError, ValueError) as e:
            raise ConfigError(f"{path}: {e}") from e


TEXTS = {"root", "backend", "http_host", "grpc_host"}


def default_root(parents: Sequence[str] | None = None, name: str = "quern-store") -> str:
    """The folder ``name`` in the first of ``parents`` that can be written to: here, where systems keep data, or the temporary one."""
    tried = []
    for parent in parents or (os.getcwd(), "/var/lib", "/data", tempfile.gettempdir()):
        path = os.path.join(parent, name)
        if os.path.isdir(parent) and os.access(parent, os.W_OK | os.X_OK):
            try:
                os.makedirs(path, exist_ok=True)
            except OSError:
                pass
            if os.path.isdir(path) and os.access(path, os.W_OK | os.X_OK):
                return f"file://{path}"
        tried.append(parent)
    raise ConfigError(f"no folder can be written to: {', '.join(tried)}")


class Engine:
    def __init__(self, spark: SparkSession, config: Config | str):
        self.spark = spark
        self.config = Config(config) if isinstance(config, str) else config
        self.catalog = Catalog(Files(spark, self.config.root))
        self._pinned: dict[str, tuple[list[int], DataFrame]] = {}

    def create_table(self, name: str, schema: TableSchema) -> None:
        self.catalog.create(name, schema)

    def drop_table(self, name: str) -> None:
        self.unpin(name)
        self.catalog.drop(name)

    def list_tables(self) -> dict[str, TableSchema]:
        return {n: e.schema for n, e in self.catalog.load().items()}

    def tables(self) -> DataFrame:
        """table_name, column_name, ordinal, dtype, nullable, is_key of all tables."""
        rows = [(t, c, i, s.dtype, s.nullable, c == schema.key) for t, schema in self.list_tables().items() for i, (c, s) in enumerate(schema.columns.items())]
        return self.spark.createDataFrame(rows, "table_name string, column_name string, ordinal int, dtype string, nullable boolean, is_key boolean")

    def get_schema(self, name: str) -> TableSchema:
        return self.catalog.entry(name).schema

    # Writing

    def write(self, name: str, batch: pa.Table | pa.RecordBatch | DataFrame, *, position=None, large_strings: bool = False, fence: tuple[str, int] | None = None) -> None:
        """Upserts whole rows: the last row of a key wins, within a batch and over batches.  An empty batch is no write."""
        schema = self.get_schema(name)
        if isinstance(batch, pa.RecordBatch):
            batch = pa.Table.from_batches([batch])
        if isinstance(batch, pa.Table):
            df = ingest.from_arrow(self.spark, batch, schema, large_strings)
            if not len(batch):
                return
        else:
            df = ingest.from_frame(batch, schema, position)
        self._append(name, df, fence)

    def write_json(self, name: str, body: bytes | str | dict) -> None:
        self.write(name, ingest.json_table(body, self.get_schema(name)))

    def write_ipc(self, name: str, body: bytes) -> None:
        self.get_schema(name)
        self.write(name, ingest.ipc_table(body))

    def write_parquet(self, name: str, source: bytes | str | list[str]) -> None:
        """From the bytes of a file, or from paths, which executors read."""
        schema = self.get_schema(name)
        if isinstance(source, bytes):
            return self.write(name, ingest.parquet_table(source))
        return self._append(name, ingest.from_parquet(self.spark, [source] if isinstance(source, str) else source, schema))

    def write_body(self, name: str, content_type: str | None, body: bytes) -> None:
        kind = content_type or ""
        if ingest.ARROW_MIME in kind:
            self.write_ipc(name, body)
        elif ingest.PARQUET_MIME in kind:
            self.write_parquet(name, body)
        else:
            self.write_json(name, body)

    def _append(self, name: str, df: DataFrame, fence: tuple[str, int] | None = None) -> None:
        segments.append(self.spark, self.catalog, name, df, tasks=self.config.write_tasks, fence=fence)
        if self.config.compact_at and len(self.catalog.entry(name).segments) >= self.config.compact_at:
            segments.compact(self.spark, self.catalog, name, tasks=self.config.write_tasks, tiered=True)
        if self.config.backend == "memory":
            self.pin(name)

    # Reading

    def _rows(self, name: str) -> tuple[TableSchema, DataFrame, object]:
        entry = self.catalog.entry(name)
        kept = self._pinned.get(name)
        if self.config.backend == "memory" and not (kept and kept[0] == entry.segments):
            self.pin(name)
            kept = self._pinned[name]
        if kept and kept[0] == entry.segments:
            return entry.schema, kept[1], lambda cut: cut
        return entry.schema, segments.scan(self.spark, self.catalog, name, entry), lambda cut: segments.latest(cut, entry.schema.key)

    def fetch(self, name: str, keys: Sequence[str] | DataFrame, columns: Sequence[str], **more) -> DataFrame:
        """A row for each key, in order, with the columns asked for; see operators.fetch."""
        schema, rows, resolve = self._rows(name)
        return fetch(self.spark, rows, resolve, schema, keys, columns, **more)

    def read(self, name: str, keys: Sequence[str], columns: Sequence[str]) -> pa.Table:
        """The same as Arrow, with the declared types."""
        schema = self.get_schema(name)
        check_columns(schema, columns)
        return egress.to_arrow(self.fetch(name, keys, columns), schema, list(columns))

    def read_body(self, name: str, accept: str | None, keys: Sequence[str], columns: Sequence[str]) -> tuple[str, bytes]:
        table = self.read(name, keys, columns)
        if ingest.ARROW_MIME in (accept or ""):
            return ingest.ARROW_MIME, egress.to_ipc(table)
        return ingest.JSON_MIME, egress.to_json(table).encode()

    def scan(self, name: str) -> DataFrame:
        """The latest row of every key, all declared columns."""
        schema, rows, resolve = self._rows(name)
        return resolve(rows).select(*(F.col(f"`{c}`") for c in schema.columns))

    # Maintenance

    def pin(self, name: str) -> None:
        """Keeps the table's latest rows in memory and on disk of the executors, until it is written again."""
        entry = self.catalog.entry(name)
        self.unpin(name)
        rows = segments.latest(segments.scan(self.spark, self.catalog, name, entry), entry.schema.key)
        self._pinned[name] = (list(entry.segments), rows.select(*(F.col(f"`{c}`") for c in entry.schema.columns)).persist())

    def unpin(self, name: str) -> None:
        if (old := self._pinned.pop(name, None)) is not None:
            old[1].unpersist()

    def compact(self, name: str) -> int | None:
        return segments.compact(self.spark, self.catalog, name, tasks=self.config.write_tasks)

    def vacuum(self, name: str) -> list[str]:
        return segments.vacuum(self.catalog, name)


def start_local(cache_dir: str | None = None) -> Engine:
    """An engine over a local session and folder."""
    spark = SparkSession.builder.master("local[*]").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    return Engine(spark, "file://" + (os.path.abspath(cache_dir) if cache_dir else tempfile.mkdtemp(prefix="quern-")))
