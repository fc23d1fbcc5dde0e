"""Adapters that serve an engine: HTTP with JSON or Arrow bodies, and Arrow Flight."""

from __future__ import annotations

import json
import re
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from quern.engine import Engine
from quern.errors import EngineError, TableError
from quern.functions.dtypes import DTYPES
from quern.functions.schema import TableSchema
from quern.sources.ingest import ARROW_MIME, JSON_MIME, PARQUET_MIME

#: The paths that clients of such stores call, and shorter ones.
ROUTE = re.compile(r"/(?:api/v1/table|tables)/([^/]+)(?:/(schema|fetch|rows|write))?")
LISTS = ("/api/v1/table", "/tables")


def openapi() -> dict:
    """The document that describes the routes, made from what the engine knows."""
    column = {"type": "object", "required": ["dtype"], "additionalProperties": False, "properties": {"dtype": {"type": "string", "enum": list(DTYPES)}, "nullable": {"type": "boolean", "default": True}}}
    schema = {"type": "object", "required": ["key", "columns"], "properties": {"key": {"type": "string"}, "columns": {"type": "object", "additionalProperties": column}}}
    values = {"type": "object", "properties": {"columns": {"type": "object", "additionalProperties": {"type": "array"}}}}
    wanted = {"type": "object", "required": ["keys", "columns"], "properties": {n: {"type": "array", "items": {"type": "string"}} for n in ("keys", "columns")}}
    body = lambda kinds, s: {"required": True, "content": {k: {"schema": s if k == JSON_MIME else {"type": "string", "format": "binary"}} for k in kinds}}
    done = lambda text: {"description": text}
    listed = {"get": {"responses": {"200": done("all tables and their schemas")}}}
    create = {"requestBody": body([JSON_MIME], schema), "responses": {"201": done("created"), "400": done("no schema"), "409": done("there already")}}
    write = {"put": {"requestBody": body([JSON_MIME, ARROW_MIME, PARQUET_MIME], values), "responses": {"200": done("written"), "400": done("rows that do not fit")}}}
    read = {"post": {"requestBody": body([JSON_MIME], wanted), "responses": {"200": done("a row for each key, as JSON or Arrow")}}}
    its = {"get": {"responses": {"200": done("its schema"), "404": done("no such table")}}}
    paths = {"/health": {"get": {"responses": {"200": done("alive")}}}, "/openapi.json": {"get": {"responses": {"200": done("this document")}}}}
    for base, name, method, rows in (("/api/v1/table", "{name}", "put", "write"), ("/tables", "{table}", "post", "rows")):
        paths |= {base: listed, f"{base}/{name}": {method: create}, f"{base}/{name}/schema": its, f"{base}/{name}/{rows}": write, f"{base}/{name}/fetch": read}
    return {"openapi": "3.1.0", "info": {"title": "Keyed tables", "version": "1"}, "paths": paths}


def handle(engine: Engine, method: str, path: str, headers: dict[str, str], body: bytes) -> tuple[int, str, bytes]:
    """Status, content type and body of the answer to a request; ``headers`` by lower-case name."""
    try:
        return _routed(engine, method, path.split("?")[0], headers, body)
    except EngineError as e:
        return e.status, JSON_MIME, json.dumps({"error": str(e)}).encode()


def _asked(body: bytes) -> tuple[list[str], list[str]]:
    try:
        value = json.loads(body)
        keys, columns = value["keys"], value["columns"]
    except (ValueError, KeyError, TypeError) as e:
        raise TableError(f"a request is {{keys: [...], columns: [...]}}: {e}") from e
    if not all(isinstance(x, list) and all(isinstance(v, str) for v in x) for x in (keys, columns)):
        raise TableError("keys and columns are lists of strings")
    return keys, columns


def _routed(engine: Engine, method: str, path: str, headers: dict[str, str], body: bytes) -> tuple[int, str, bytes]:
    as_json = lambda value, status=200: (status, JSON_MIME, json.dumps(value).encode())
    if (method, path) == ("GET", "/health"):
        return 200, "text/plain", b"OK"
    if (method, path) == ("GET", "/openapi.json"):
        return as_json(openapi())
    if method == "GET" and path in LISTS:
        return as_json({n: s.to_json() for n, s in engine.list_tables().items()})
    if m := ROUTE.fullmatch(path):
        name, what = m.groups()
        if method in ("POST", "PUT") and what is None:
            try:
                value = json.loads(body)
            except ValueError as e:
                raise TableError(f"not JSON: {e}") from e
            engine.create_table(name, TableSchema.from_json(value))
            return as_json({}, 201)
        if (method, what) == ("GET", "schema"):
            return as_json(engine.get_schema(name).to_json())
        if method == "PUT" and what in ("rows", "write"):
            if len(body) > engine.config.body_limit:
                return as_json({"error": "the body is too large"}, 413)
            engine.write_body(name, headers.get("content-type"), body)
            return as_json({})
        if (method, what) == ("POST", "fetch"):
            return 200, *engine.read_body(name, headers.get("accept"), *_asked(body))
    return as_json({"error": f"no route {method} {path}"}, 404)


def http_server(engine: Engine, host: str | None = None, port: int | None = None) -> ThreadingHTTPServer:
    """A server for the routes of handle(); call serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def _answer(self):
            n = int(self.headers.get("content-length") or 0)
            if n > engine.config.body_limit:
                self.close_connection = True
                status, kind, out = 413, JSON_MIME, b'{"error": "the body is too large"}'
            else:
                status, kind, out = handle(engine, self.command, self.path, {k.lower(): v for k, v in self.headers.items()}, self.rfile.read(n))
            self.send_response(status)
            self.send_header("content-type", kind)
            self.send_header("content-length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        do_GET = do_POST = do_PUT = _answer

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer((host or engine.config.http_host, engine.config.http_port if port is None else port), Handler)


def flight_server(engine: Engine, location: str | None = None):
    """A Flight server: do_get by a JSON ticket {table, keys, columns}, schemas and the list of tables; no writes."""
    import pyarrow.flight as fl

    kinds = {"NOT_FOUND": KeyError, "INVALID_ARGUMENT": fl.FlightServerError}

    def table_of(descriptor) -> str:
        if not descriptor.path:
            raise fl.FlightServerError("a path names the table")
        return descriptor.path[0].decode()

    def guarded(call):
        try:
            return call()
        except EngineError as e:
            raise kinds.get(e.code, fl.FlightInternalError)(f"{e.code}: {e}") from e

    class Server(fl.FlightServerBase):
        def _info(self, name: str, schema: TableSchema):
            return fl.FlightInfo(schema.arrow(), fl.FlightDescriptor.for_path(name), [], -1, -1)

        def do_get(self, _context, ticket):
            def call():
                try:
                    asked = json.loads(ticket.ticket)
                    name = asked["table"]
                except (ValueError, KeyError, TypeError) as e:
                    raise TableError(f"not a ticket: {e}") from e
                keys, columns = _asked(ticket.ticket)
                return fl.RecordBatchStream(engine.read(name, keys, columns))

            return guarded(call)

        def get_flight_info(self, _context, descriptor):
            name = table_of(descriptor)
            return self._info(name, guarded(lambda: engine.get_schema(name)))

        def get_schema(self, _context, descriptor):
            name = table_of(descriptor)
            return fl.SchemaResult(guarded(lambda: engine.get_schema(name)).arrow())

        def list_flights(self, _context, _criteria):
            for name, schema in engine.list_tables().items():
                yield self._info(name, schema)

    return Server(location or f"grpc://{engine.config.grpc_host}:{engine.config.grpc_port}")


