import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quern.plans import edges
from quern.plans.queries import ORACLE_SQL, QUERIES, array_rows, numbered, with_orders

QUERIES, ORACLE_SQL = QUERIES | edges.QUERIES, ORACLE_SQL | edges.ORACLE_SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", QUERIES)
def test_agrees_with_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    ours = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    cur = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == names
    assert sorted((tuple(r[columns.index(c)] for c in names) for r in cur.fetchall()), key=repr) == ours


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_arrays_of_every_id(spark, sf_dir, con):
    """The SQL of array_fetch_ext fixes its ids; here they are all of the table, and as many that are missing."""
    last = con.execute("SELECT max(vec_id) FROM embeddings").fetchone()[0]
    got = sorted(tuple(r) for r in array_rows(spark, sf_dir, spark.range(0, 2 * last + 2)).select("ord", "n", "first").collect())
    assert got == con.execute(f"SELECT r.range, len(embedding)::INTEGER, embedding[1] FROM range(0, {2 * last + 2}) r LEFT JOIN embeddings ON vec_id = r.range ORDER BY 1").fetchall()


def test_projection_of_every_order(spark, sf_dir, con):
    last = con.execute("SELECT max(o_orderkey) FROM orders").fetchone()[0]
    names = ["o_custkey", "o_orderpriority", "o_totalprice"]
    out = with_orders(spark, sf_dir).fetch("orders", numbered([str(i) for i in range(last + 100)], spark), names)
    got = sorted(tuple(r) for r in out.select("ord", *names).collect())
    assert got == con.execute(f"SELECT r.range, {', '.join(names)} FROM range(0, {last + 100}) r LEFT JOIN orders ON o_orderkey = r.range ORDER BY 1").fetchall()


@pytest.mark.parametrize(("parts", "orders"), [([0, 65535, 65536, 131071, 2**32 + 5, 2**40, None], [1]), ([7], [2**31 - 1, 2**31])])
def test_types_of_large_keys(spark, tmp_path, parts, orders):
    """Keys beyond the narrow types, as larger tables have them: more than 16 bits of a part, the last order whose negative fits 32."""
    rows = [(o, p, 1 + i % 2, 100.0 + i, 0.05, "R", "O") for o in orders for i, p in enumerate(parts) for _ in range(2)]
    kinds = {"l_orderkey": pa.int64(), "l_partkey": pa.int64(), "l_linenumber": pa.int32(), "l_extendedprice": pa.float64(), "l_discount": pa.float64(), "l_returnflag": pa.string(), "l_linestatus": pa.string()}
    pq.write_table(pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds)), tmp_path / "lineitem.parquet")
    df = QUERIES["dtype_matrix"](spark, f"file://{tmp_path}")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    want = sorted(c.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL['dtype_matrix']})").fetchall())
    assert sorted(map(tuple, df.collect())) == want and len(want) == min(2, len(parts))
