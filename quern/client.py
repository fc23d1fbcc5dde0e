"""Clients of a store that is served over HTTP, for callers with and without an event loop."""

from __future__ import annotations

import asyncio
import json
import urllib.error
import urllib.request
from collections.abc import Sequence
from urllib.parse import quote

import pyarrow as pa

from quern import errors
from quern.functions.schema import TableSchema
from quern.sources import egress, ingest

KINDS = {404: errors.TableNotFound, 409: errors.TableAlreadyExists, 400: errors.TableError}


class Client:
    """The calls of an engine against a server; batches travel as Arrow streams."""

    def __init__(self, url: str, timeout: float = 60.0):
        self.url, self.timeout = url.rstrip("/"), timeout

    def _call(self, method: str, path: str, body: bytes | None = None, **headers: str) -> bytes:
        request = urllib.request.Request(self.url + path, data=body, method=method, headers={k.replace("_", "-"): v for k, v in headers.items()})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return answer.read()
        except urllib.error.HTTPError as e:
            said = e.read().decode(errors="replace")
            raise KINDS.get(e.code, errors.EngineError)(f"{e.code}: {said}") from e
        except OSError as e:
            raise errors.StorageError(f"{self.url}: {e}") from e

    @staticmethod
    def _path(name: str, what: str = "") -> str:
        return f"/api/v1/table/{quote(name, safe='')}{what}"

    def list_tables(self) -> dict[str, TableSchema]:
        return {n: TableSchema.from_json(s) for n, s in json.loads(self._call("GET", "/api/v1/table")).items()}

    def get_schema(self, name: str) -> TableSchema:
        return TableSchema.from_json(json.loads(self._call("GET", self._path(name, "/schema"))))

    def create_table(self, name: str, schema: TableSchema) -> None:
        self._call("PUT", self._path(name), json.dumps(schema.to_json()).encode(), content_type=ingest.JSON_MIME)

    def write(self, name: str, batch: pa.Table | pa.RecordBatch) -> None:
        table = pa.Table.from_batches([batch]) if isinstance(batch, pa.RecordBatch) else batch
        self._call("PUT", self._path(name, "/write"), egress.to_ipc(table), content_type=ingest.ARROW_MIME)

    def read(self, name: str, keys: Sequence[str], columns: Sequence[str]) -> pa.Table:
        asked = json.dumps({"keys": list(keys), "columns": list(columns)}).encode()
        with pa.ipc.open_stream(self._call("POST", self._path(name, "/fetch"), asked, content_type=ingest.JSON_MIME, accept=ingest.ARROW_MIME)) as stream:
            return stream.read_all()


class AsyncClient:
    """The same calls, awaited; each runs in a thread of its own."""

    def __init__(self, url: str, timeout: float = 60.0):
        self._client = Client(url, timeout)

    def __getattr__(self, name: str):
        call = getattr(self._client, name)

        async def run(*args, **more):
            return await asyncio.to_thread(call, *args, **more)

        return run
