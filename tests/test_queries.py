"""Every registered scene query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
SCENE = __import__("scenelake.plans", fromlist=["QUERIES"]).QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    return float(v) if type(v).__name__ == "Decimal" else tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x) if isinstance(x, (str, tuple)) else "", 0 if x is None or isinstance(x, (str, tuple)) else x) for x in r))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SCENE))
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = ordered([tuple(plain(r[c]) for c in columns) for r in df.collect()])
    sql = entry.oracle_sql()[name]  # every scene query has its SQL; one without would need a test of its own, named here
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == ordered([tuple(plain(r[i]) for i in at) for r in cur.fetchall()])


def test_entry_is_stable(spark):
    assert entry.entry(spark).columns == ["gaussian_index", "object_id"]


def test_nothing_else_imports_the_text_operators():
    for folder, _, files in os.walk(os.path.dirname(entry.__file__) + "/scenelake"):
        if folder.endswith("/llm"):
            continue
        for f in files:
            if f.endswith(".py"):
                with open(f"{folder}/{f}") as h:
                    assert "scenelake.llm" not in h.read(), f


def test_instance_keys_past_four_digits(spark, tmp_path):
    supplier = spark.read.parquet(f"{SF}/supplier.parquet").limit(1)
    rows = spark.createDataFrame([(7,), (9999,), (10000,), (123456,)], "s_suppkey long").crossJoin(supplier.drop("s_suppkey"))
    rows.write.parquet(str(tmp_path / "supplier.parquet"))
    got = {r["instance_id"]: r["by_local"] for r in SCENE["p27_instance_keys"](spark, str(tmp_path)).collect()}
    assert got == {7: "00002:0007", 9999: "00004:9999", 10000: "00000:10000", 123456: "00001:123456"}
