"""Every query with an oracle gives DuckDB's rows, on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__  # noqa: F401  its plans register their queries in the catalogue
from fathomlake.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    assert got
    if name in catalogue.ORACLES:
        quoted = ", ".join(f'"{n}"' for n in names)
        assert sorted(duck.sql(catalogue.ORACLES[name]).columns) == names
        assert got == sorted(tuple(plain(v) for v in r) for r in duck.sql(f"SELECT {quoted} FROM ({catalogue.ORACLES[name]})").fetchall())


def test_word_subset_drop_whole(spark, duck):
    names = duck.sql("SELECT p_size, p_partkey, p_name || CASE WHEN p_partkey % 3 = 0 THEN ' plus' ELSE '' END FROM part").fetchall()
    words = [(scope, set(name.lower().split())) for scope, _, name in names]
    want = {row for row, (scope, own) in zip(names, words) if not any(s == scope and own < other for s, other in words)}
    got = [tuple(r) for r in catalogue.QUERIES["word_subset_drop_whole"](spark, SF).collect()]
    assert len(got) == len(want) and set(got) == want and max(got)[0] > 10
