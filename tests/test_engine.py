import json
import threading
import urllib.error
import urllib.request

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quern import errors
from quern.engine import ColumnSchema, Config, DType, Engine, TableSchema
from quern.operators import segments
from quern.sources import egress, transport
from quern.streaming.upsert import upsert_stream

SCORES = TableSchema("id", {"id": ColumnSchema("utf8", False), "score": ColumnSchema("float32"), "label": ColumnSchema("utf8")})


def rows(**columns) -> pa.Table:
    types = {"id": pa.string(), "score": pa.float32(), "label": pa.string()}
    n = len(columns["id"])
    return pa.table({c: pa.array(columns.get(c, [None] * n), t) for c, t in types.items()})


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, Config(f"file://{tmp_path}/store", compact_at=0))
    e.create_table("t", SCORES)
    return e


def got(engine, keys, columns, table="t"):
    return [c.to_pylist() for c in engine.read(table, keys, columns).columns]


def test_round_trip_order_and_projection(engine):
    engine.write("t", rows(id=["a", "b", "c"], score=[1.0, None, 3.0], label=["x", "", None]))
    assert got(engine, ["c", "zzz", "a", "b", "a"], ["score", "label"]) == [[3.0, None, 1.0, None, 1.0], [None, None, "x", "", "x"]]
    assert engine.read("t", ["a"], ["label", "score"]).column_names == ["label", "score"]
    assert engine.read("t", ["a"], ["score", "score"]).column_names == ["score", "score"]
    assert engine.read("t", [], ["score"]).schema == pa.schema([("score", pa.float32())])
    assert got(engine, ["a", "nope"] * 5, ["score"]) == [[1.0, None] * 5]


def test_errors(engine):
    engine.write("t", rows(id=["a"], score=[1.0]))
    for columns, kind in ((["nope"], errors.SegmentError), (["id"], errors.SegmentError), ([], errors.ArrowError)):
        with pytest.raises(kind):
            engine.read("t", ["a"], columns)
    with pytest.raises(errors.TableNotFound):
        engine.read("u", ["a"], ["nope"])
    with pytest.raises(errors.TableNotFound):
        engine.write("u", rows(id=["a"]))
    with pytest.raises(errors.TableAlreadyExists):
        engine.create_table("t", SCORES)
    for name in ("", "a/b", "..", "_x"):
        with pytest.raises(errors.TableError):
            engine.create_table(name, SCORES)
    with pytest.raises(errors.TableError):
        engine.create_table("bad", TableSchema("id", {"id": ColumnSchema("float32")}))
    assert "bad" not in engine.list_tables()
    with pytest.raises(errors.SegmentError):
        engine.write("t", rows(id=["a", None]))
    with pytest.raises(errors.SegmentError):
        engine.read("t", [None], ["score"])


def test_last_write_wins(engine):
    engine.write("t", rows(id=["a", "b", "a"], score=[1.0, 2.0, 9.0], label=["x", "y", "z"]))
    assert got(engine, ["a"], ["score", "label"]) == [[9.0], ["z"]]
    engine.write("t", rows(id=["a"], score=[None], label=["w"]))
    assert got(engine, ["a", "b"], ["score", "label"]) == [[None, 2.0], ["w", "y"]]
    engine.write("t", rows(id=["c"], score=[4.0]))
    assert sorted(r.id for r in engine.scan("t").collect()) == ["a", "b", "c"]


def test_empty(engine):
    assert got(engine, ["a", "b"], ["score"]) == [[None, None]]
    engine.write("t", rows(id=[]))
    assert engine.catalog.entry("t").segments == [] and engine.scan("t").count() == 0


def test_compaction_changes_no_result(engine, spark):
    for i in range(4):
        engine.write("t", rows(id=[str(j) for j in range(i, i + 5)], score=[float(i)] * 5))
    before = sorted(engine.scan("t").collect())
    old = engine.catalog.entry("t").segments
    assert engine.compact("t") > old[-1] and len(engine.catalog.entry("t").segments) == 1
    assert sorted(engine.scan("t").collect()) == before and engine.compact("t") is None
    engine.write("t", rows(id=["0"], score=[7.0]))
    assert got(engine, ["0", "7"], ["score"]) == [[7.0, 3.0]]
    assert len(engine.vacuum("t")) >= len(old)
    assert got(engine, ["0", "7"], ["score"]) == [[7.0, 3.0]]


def test_compaction_keeps_later_writes(engine, spark, monkeypatch):
    engine.write("t", rows(id=["a"], score=[1.0]))
    engine.write("t", rows(id=["a"], score=[2.0]))
    put = segments._write
    monkeypatch.setattr(segments, "_write", lambda *a: (put(*a), monkeypatch.undo(), engine.write("t", rows(id=["a"], score=[3.0])))[0])
    engine.compact("t")
    assert len(engine.catalog.entry("t").segments) == 2 and got(engine, ["a"], ["score"]) == [[3.0]]


def test_automatic_compaction(spark, tmp_path):
    e = Engine(spark, Config(f"file://{tmp_path}/s", compact_at=3))
    e.create_table("t", SCORES)
    for i in range(3):
        e.write("t", rows(id=["a"], score=[float(i)]))
    assert len(e.catalog.entry("t").segments) == 1 and got(e, ["a"], ["score"]) == [[2.0]]


def test_reopen_and_skip(engine, spark):
    engine.write("t", rows(id=["a"], score=[1.0]))
    again = Engine(spark, engine.config)
    assert again.get_schema("t") == SCORES and got(again, ["a"], ["score"]) == [[1.0]]
    raw = json.loads(engine.catalog.files.read("manifest.json"))
    raw["tables"]["broken"] = {"schema": {"key": "x", "columns": {}}, "segments": [], "next": 2}
    engine.catalog.files.replace("manifest.json", json.dumps(raw).encode())
    assert set(again.list_tables()) == {"t"}
    again.create_table("u", SCORES)
    assert "broken" in json.loads(engine.catalog.files.read("manifest.json"))["tables"]
    again.drop_table("u")
    with pytest.raises(errors.TableNotFound):
        again.drop_table("u")


def test_lock(engine):
    engine.catalog.patience = 0.1
    engine.catalog.files.create("manifest.lock", b"other")
    with pytest.raises(errors.StorageError):
        engine.create_table("u", SCORES)
    engine.catalog.files.delete("manifest.lock")
    engine.create_table("u", SCORES)


def test_frames(engine, spark):
    df = spark.createDataFrame([("a", 1.0, "x", 5), ("a", 2.0, "y", 4)], "id string, score float, label string, at long")
    engine.write("t", df, position=F.col("at"))
    assert got(engine, ["a"], ["score"]) == [[1.0]]
    with pytest.raises(errors.SegmentError):
        engine.write("t", df.withColumn("score", F.col("score").cast("double")))
    with pytest.raises(errors.SegmentError):
        engine.write("t", df.drop("label"))
    with pytest.raises(errors.SegmentError):
        engine.write("t", df.withColumn("id", F.lit(None).cast("string")))
    assert len(engine.catalog.entry("t").segments) == 1 and not [n for n in engine.catalog.files.names("t") if n.startswith(".staging")]
    keys = spark.createDataFrame([(7, "a"), (3, None), (5, "q")], "ord long, key string")
    out = engine.fetch("t", keys, ["label"], with_key=True, with_found=True).collect()
    assert [tuple(r) for r in out] == [(3, None, False, None), (5, "q", False, None), (7, "a", True, "x")]


def test_unsigned(spark, engine):
    s = TableSchema("k", {"k": ColumnSchema("utf8")} | {f"u{b}": ColumnSchema(f"uint{b}") for b in (8, 16, 32, 64)})
    engine.create_table("u", s)
    top = {f"u{b}": 2**b - 1 for b in (8, 16, 32, 64)}
    engine.write("u", pa.table({"k": ["a"]} | {n: pa.array([v], getattr(pa, f"uint{n[1:]}")()) for n, v in top.items()}))
    out = engine.read("u", ["a"], list(top))
    assert [c.to_pylist() for c in out.columns] == [[v] for v in top.values()] and out.schema.field("u64").type == pa.uint64()
    with pytest.raises(errors.SegmentError):
        engine.write("u", engine.scan("u").withColumn("u8", F.lit(256).cast("short")))


def test_parquet_paths_order_by_file_then_row(engine, tmp_path):
    pq.write_table(rows(id=["a", "a"], score=[1.0, 2.0]), tmp_path / "p-0.parquet")
    pq.write_table(rows(id=["b", "b"], score=[3.0, 4.0]), tmp_path / "p-1.parquet")
    engine.write_parquet("t", [f"{tmp_path}/p-0.parquet", f"{tmp_path}/p-1.parquet"])
    assert got(engine, ["a", "b"], ["score"]) == [[2.0, 4.0]]


def test_pinned(engine):
    engine.write("t", rows(id=["a"], score=[1.0]))
    engine.pin("t")
    assert got(engine, ["a"], ["score"]) == [[1.0]]
    engine.write("t", rows(id=["a"], score=[2.0]))
    assert got(engine, ["a"], ["score"]) == [[2.0]]
    engine.unpin("t")


def test_plan_cuts_rows_before_versions(engine, spark):
    engine.write("t", rows(id=["a"], score=[1.0]))
    plan = engine.fetch("t", ["a", "b"], ["score"])._jdf.queryExecution().executedPlan().toString()
    assert "In(id, [a,b])" in plan.replace("In(id, [b,a])", "In(id, [a,b])") and "label" not in plan.split("ReadSchema")[1]
    keys = spark.createDataFrame([(0, "a")], "ord long, key string")
    lines = engine.fetch("t", keys, ["score"])._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda what: next(i for i, x in enumerate(lines) if what in x)
    assert depth("LeftSemi") > depth("Window")


def test_stream(engine, spark, tmp_path):
    source = f"{tmp_path}/in"
    spark.createDataFrame([("a", 1.0, "x", 1), ("a", 2.0, "y", 2)], "id string, score float, label string, at long").write.parquet(source)
    stream = spark.readStream.schema("id string, score float, label string, at long").parquet(source)
    upsert_stream(engine, "t", stream, f"{tmp_path}/c", position="at", available_now=True).awaitTermination()
    assert got(engine, ["a"], ["label"]) == [["y"]]


def test_http(engine):
    call = lambda method, path, body=b"", **h: transport.handle(engine, method, path, h, body)
    assert call("GET", "/health")[0] == 200
    paths = json.loads(call("GET", "/openapi.json")[2])["paths"]
    assert "/tables/{table}/fetch" in paths
    made = json.dumps(SCORES.to_json()).encode()
    assert call("POST", "/tables/h", made)[0] == 201 and call("POST", "/tables/h", made)[0] == 409
    assert call("POST", "/tables/i", b"{}")[0] == 400 and call("POST", "/tables/i", b"{")[0] == 400
    assert json.loads(call("GET", "/tables")[2])["h"] == SCORES.to_json() == json.loads(call("GET", "/tables/h/schema")[2])
    assert call("PUT", "/tables/h/rows", b'{"columns": {"id": ["a"], "score": [1.5], "label": [null]}}')[0] == 200
    status, kind, body = call("POST", "/tables/h/fetch", b'{"keys": ["a", "b"], "columns": ["score"]}')
    assert (status, json.loads(body)) == (200, {"columns": {"score": [1.5, None]}})
    ipc = call("POST", "/tables/h/fetch", b'{"keys": ["a"], "columns": ["score"]}', accept="application/vnd.apache.arrow.stream")
    assert pa.ipc.open_stream(ipc[2]).read_all().to_pydict() == {"score": [1.5]}
    sink = pa.BufferOutputStream()
    pq.write_table(rows(id=["x"], score=[10.0]), sink)
    call("PUT", "/tables/h/rows", sink.getvalue().to_pybytes(), **{"content-type": "application/vnd.apache.parquet"})
    call("PUT", "/tables/h/rows", egress.to_ipc(rows(id=["c"], score=[3.0])), **{"content-type": "application/vnd.apache.arrow.stream"})
    assert got(engine, ["x", "c", "a"], ["score"], "h") == [[10.0, 3.0, 1.5]]
    assert call("POST", "/tables/none/fetch", b'{"keys": ["a"], "columns": ["score"]}')[0] == 404
    assert call("POST", "/tables/h/fetch", b'{"keys": ["a"], "columns": ["nope"]}')[0] == 400
    assert call("POST", "/tables/h/fetch", b'{"keys": ["a"], "columns": []}')[0] == 500
    assert call("POST", "/tables/h/fetch", b"nonsense")[0] == 400 and call("DELETE", "/tables/h")[0] == 404
    assert set(json.loads(call("GET", "/tables/none/schema")[2])) == {"error"}


def test_http_socket(engine):
    server = transport.http_server(engine, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        assert urllib.request.urlopen(f"{base}/tables").status == 200
        with pytest.raises(urllib.error.HTTPError):
            urllib.request.urlopen(f"{base}/nothing")
    finally:
        server.shutdown()
        server.server_close()


def test_flight(engine):
    fl = pytest.importorskip("pyarrow.flight")
    engine.write("t", rows(id=["a"], score=[1.0]))
    with transport.flight_server(engine, "grpc://127.0.0.1:0") as server, fl.connect(f"grpc://127.0.0.1:{server.port}") as client:
        ticket = fl.Ticket(json.dumps({"table": "t", "keys": ["a", "b"], "columns": ["score"]}).encode())
        assert client.do_get(ticket).read_all().to_pydict() == {"score": [1.0, None]}
        assert client.get_schema(fl.FlightDescriptor.for_path("t")).schema == SCORES.arrow()
        assert client.get_flight_info(fl.FlightDescriptor.for_path("t")).endpoints == []
        assert [f.descriptor.path for f in client.list_flights()] == [[b"t"]]
        for bad in (b"x", json.dumps({"table": "u", "keys": [], "columns": ["score"]}).encode()):
            with pytest.raises((fl.FlightError, KeyError, pa.ArrowException)):
                client.do_get(fl.Ticket(bad)).read_all()


def test_names_of_types():
    assert ColumnSchema(DType.FLOAT32) == ColumnSchema("float32") and len(DType) == 12
    assert json.dumps(TableSchema("k", {"k": ColumnSchema(DType.UTF8)}).to_json()) == json.dumps(TableSchema("k", {"k": ColumnSchema("utf8")}).to_json())


def test_config():
    c = Config.load({"root": "/x", "compact_at": 5}, {"QUERN_HTTP_PORT": "9000", "QUERN_COMPACT_AT": "7"})
    assert (c.http_port, c.compact_at, c.root) == (9000, 7, "/x")
    for bad in ({}, {"root": "/x", "nope": 1}, {"root": "/x", "compact_at": "many"}):
        with pytest.raises(errors.ConfigError):
            Config.load(bad, {})


def test_segments_are_files_of_disjoint_sorted_ranges(spark, tmp_path):
    e = Engine(spark, Config(f"file://{tmp_path}/s", compact_at=0, write_tasks=6))
    e.create_table("t", SCORES)
    for k in range(2):
        e.write("t", spark.range(30_000).selectExpr("cast(id as string) id", f"float(id + {k}) score", "'x' label"))

    def ranges():
        for folder in sorted(tmp_path.glob("s/t/__seq=*")):
            found = sorted(pq.read_table(f)["id"].to_pylist() for f in folder.glob("*.parquet") if pq.read_metadata(f).num_rows)
            yield folder.name, found

    def check(found):
        assert len(found) > 3 and all(k == sorted(k) for k in found) and all(a[-1] < b[0] for a, b in zip(found, found[1:]))

    for _, found in ranges():
        check(found)
    e.compact("t")
    check(list(ranges())[-1][1])
    assert got(e, ["7", "29999", "30000"], ["score"]) == [[8.0, 30000.0, None]]


def test_tiers():
    assert segments.newest_tier([100, 10, 9, 8]) == 1 and segments.newest_tier([5, 5, 5]) == 0
    assert segments.newest_tier([1000, 100, 10, 1]) == 3 and segments.newest_tier([7]) == 0 and segments.newest_tier([]) == 0


def test_automatic_compaction_spares_large_segments(spark, tmp_path):
    e = Engine(spark, Config(f"file://{tmp_path}/s", compact_at=3))
    e.create_table("t", SCORES)
    e.write("t", spark.range(50_000).selectExpr("cast(id as string) id", "float(id) score", "uuid() label"))
    large = e.catalog.entry("t").segments[0]
    for i in range(5):
        e.write("t", rows(id=["a", "7"], score=[float(i), float(i)]))
    now = e.catalog.entry("t").segments
    assert now[0] == large and len(now) == 2 and got(e, ["a", "7", "8"], ["score"]) == [[4.0, 4.0, 8.0]]
    e.compact("t")
    e.write("t", rows(id=["a"], score=[9.0]))
    assert len(set(e.catalog.entry("t").segments)) == 2 and got(e, ["a", "7", "8"], ["score"]) == [[9.0, 4.0, 8.0]]


def test_lock_of_a_writer_that_is_gone(engine):
    engine.catalog.files.create("manifest.lock", b"other 1000000000")
    engine.create_table("u", SCORES)
    with pytest.raises(errors.StorageError), engine.catalog.change() as tables:
        tables.pop("u")
        engine.catalog.files.replace("manifest.lock", b"another 1")
    assert "u" in engine.list_tables() and engine.catalog.files.read("manifest.lock") == b"another 1"


def test_replayed_batches_are_not_written_again(engine):
    engine.write("t", rows(id=["a"], score=[1.0]), fence=("s", 0))
    engine.write("t", rows(id=["a"], score=[2.0]))
    engine.write("t", rows(id=["a"], score=[1.0]), fence=("s", 0))
    assert got(engine, ["a"], ["score"]) == [[2.0]]
    engine.write("t", rows(id=["a"], score=[3.0]), fence=("s", 1))
    engine.write("t", rows(id=["b"], score=[4.0]), fence=("other", 0))
    assert got(engine, ["a", "b"], ["score"]) == [[3.0, 4.0]] and len(engine.catalog.entry("t").segments) == 4


def test_unordered(engine, spark):
    engine.write("t", rows(id=["a"], score=[1.0]))
    keys = spark.createDataFrame([(7, "a"), (3, None)], "ord long, key string")
    out = engine.fetch("t", keys, ["score"], ordered=False)
    assert sorted((r.ord, r.score) for r in out.collect()) == [(3, None), (7, 1.0)]
    assert "Sort [__ord" not in out._jdf.queryExecution().executedPlan().toString()


def test_memory_backend(spark, tmp_path):
    e = Engine(spark, Config(f"file://{tmp_path}/s", backend="memory"))
    e.create_table("t", SCORES)
    assert got(e, ["a"], ["score"]) == [[None]]
    for v in (1.0, 2.0):
        e.write("t", rows(id=["a"], score=[v]))
        assert got(e, ["a"], ["score"]) == [[v]]
    assert "InMemoryTableScan" in e.fetch("t", ["a"], ["score"])._jdf.queryExecution().executedPlan().toString()
    again = Engine(spark, e.config)
    assert got(again, ["a", "b"], ["score"]) == [[2.0, None]]
    e.unpin("t")
    again.unpin("t")


def test_http_paths_of_clients(engine):
    call = lambda method, path, body=b"", **h: transport.handle(engine, method, path, h, body)
    document = json.loads(call("GET", "/openapi.json")[2])
    assert document["openapi"] == "3.1.0" and "/api/v1/table/{name}/fetch" in document["paths"] and call("GET", "/health")[2] == b"OK"
    made = json.dumps(SCORES.to_json()).encode()
    base = "/api/v1/table"
    assert call("GET", f"{base}/h/schema")[0] == 404
    assert call("PUT", f"{base}/h", made)[0] == 201 and call("PUT", f"{base}/h", made)[0] == 409
    assert call("PUT", f"{base}/h/write", b'{"columns": {"id": ["a"], "score": [1.5], "label": [null]}}')[0] == 200
    assert json.loads(call("POST", f"{base}/h/fetch", b'{"keys": ["a", "b"], "columns": ["score", "score"]}')[2]) == {"columns": {"score": [1.5, None]}}
    assert json.loads(call("GET", base)[2])["h"] == json.loads(call("GET", f"{base}/h/schema")[2])


def test_clients(engine):
    import asyncio

    from quern.client import AsyncClient, Client

    server = transport.http_server(engine, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        c = Client(f"http://127.0.0.1:{server.server_port}")
        c.create_table("c", SCORES)
        c.write("c", rows(id=["a", "b"], score=[1.0, None], label=["x", None]))
        assert c.read("c", ["b", "a", "q"], ["score", "label"]).to_pydict() == {"score": [None, 1.0, None], "label": [None, "x", None]}
        assert c.get_schema("c") == SCORES == c.list_tables()["c"]
        for kind, run in ((errors.TableNotFound, lambda: c.get_schema("no")), (errors.TableAlreadyExists, lambda: c.create_table("c", SCORES)), (errors.TableError, lambda: c.read("c", ["a"], ["no"]))):
            with pytest.raises(kind):
                run()

        async def both():
            a = AsyncClient(c.url)
            return await asyncio.gather(a.read("c", ["a"], ["score"]), a.read("c", ["b"], ["label"]))

        assert [t.to_pydict() for t in asyncio.run(both())] == [{"score": [1.0]}, {"label": [None]}]
    finally:
        server.shutdown()
        server.server_close()
    with pytest.raises(errors.StorageError):
        c.list_tables()


def test_config_files_and_roots(tmp_path):
    from quern.__main__ import config
    from quern.engine import default_root

    (tmp_path / "c.toml").write_text('root = "/y"\nbackend = "memory"\nhttp_host = "0.0.0.0"\n')
    (tmp_path / "c.json").write_text('{"root": "/z", "grpc_port": 1}')
    (tmp_path / "bad.toml").write_text("root = ")
    c = Config.load(str(tmp_path / "c.toml"), {"QUERN_HTTP_HOST": "::1"})
    assert (c.root, c.backend, c.http_host) == ("/y", "memory", "::1") and Config.load(str(tmp_path / "c.json"), {}).grpc_port == 1
    for bad in (str(tmp_path / "bad.toml"), str(tmp_path / "none.toml"), {"root": "/x", "backend": "tape"}):
        with pytest.raises(errors.ConfigError):
            Config.load(bad, {})
    assert config(["--config", str(tmp_path / "c.json")], {"QUERN_GRPC_PORT": "2"}).grpc_port == 2
    assert default_root([str(tmp_path / "no"), str(tmp_path)], "st") == f"file://{tmp_path}/st" and (tmp_path / "st").is_dir()
    with pytest.raises(errors.ConfigError):
        default_root([str(tmp_path / "no")])


def test_entry_without_the_optional_package(tmp_path):
    """The engine's queries stay when something that the optional package needs is missing."""
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parents[1]
    hide = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", hide], cwd=repo, capture_output=True, text=True, check=True).stdout.split()
    from quern.plans import edges, queries

    own = queries.QUERIES | edges.QUERIES
    assert out == [str(len(own)), str(len(queries.ORACLE_SQL | edges.ORACLE_SQL)), "False"]


def test_scratch_needs_a_shared_folder():
    from types import SimpleNamespace

    from quern.sources.scratch import scratch

    none = SimpleNamespace(get=lambda *a: None)
    cluster = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: none, master="spark://x:7077"), conf=none)
    with pytest.raises(errors.ConfigError):
        scratch(cluster, "x")
