"""Every registered query against its SQL form over the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from carteframe.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(values):
    return sorted((tuple(plain(v) for v in r) for r in values), key=repr)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, small, name):
    df = registry.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = rows(df.select(*columns).collect())
    if name in registry.ORACLES:
        want = duck.sql(registry.ORACLES[name])
        assert sorted(want.columns) == columns
        assert got == rows(want.select(*(f'"{c}"' for c in columns)).fetchall())
    else:
        assert got


def test_every_query_but_the_sequential_has_sql():
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"duplicate_names_fuzzy", "header_mapping", "line_types", "rate_limit_admission", "category_classifier", "word_lines"}


def test_price_assessment_makes_no_pairs(spark, tmp_path):
    """2,000 own prices and 2,000 anchors in one category: all is compared with the SQL, next to nothing is exchanged."""
    spark.sql("SELECT id AS p_partkey, 'pie' AS p_name, 'm' AS p_brand, 'ECONOMY' AS p_type, 1 AS p_size, CAST(10000 + id AS DOUBLE) AS p_retailprice FROM range(4000)").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: sum(found.apply(i).totalShuffleWrite() for found in [store.executorList(False)] for i in range(found.size()))
    before = written()
    got = registry.QUERIES["price_assessment"](spark, str(tmp_path)).collect()
    assert written() - before < 2_000_000
    assert rows(got) == rows(con.sql(registry.ORACLES["price_assessment"]).fetchall())


def test_price_assessment_exchanges_less_than_it_reads(spark, tmp_path):
    """40,000 parts, nearly all of a price of their own: own rows stay where they are read, only the anchors' prices are counted over an exchange."""
    made = "SELECT id AS p_partkey, 'pie' AS p_name, 'm' AS p_brand, element_at(array('ECONOMY', 'SMALL', 'PROMO'), CAST(1 + id DIV 2 % 3 AS INT)) AS p_type, CAST(1 + xxhash64(id) & 31 AS INT) AS p_size, CAST(900 + (xxhash64(id, 1) & 1048575) / 100 AS DOUBLE) AS p_retailprice FROM range(40000)"
    spark.sql(made).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    read = sum(p.stat().st_size for p in tmp_path.glob("part.parquet/*.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: sum(found.apply(i).totalShuffleWrite() for found in [store.executorList(False)] for i in range(found.size()))
    before = written()
    got = registry.QUERIES["price_assessment"](spark, str(tmp_path)).collect()
    assert written() - before < read
    assert len(got) > 19_000 and rows(got) == rows(con.sql(registry.ORACLES["price_assessment"]).fetchall())
