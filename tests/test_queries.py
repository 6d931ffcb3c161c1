"""Every core query against its SQL in DuckDB, over the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from changelens.plans import registry
from changelens.plans.registry import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, (bool, str)):
        return v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in records), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_oracle_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    duck.execute(ORACLES[name])
    theirs = rows([d[0] for d in duck.description], duck.fetchall())
    assert mine == theirs


def test_flagship_is_registered():
    assert registry.FLAGSHIP in QUERIES
    assert set(QUERIES) - set(ORACLES) == {"semantic_ann"}


def test_merged_ranges_of_odd_lines_are_those_of_the_sql(spark, tmp_path):
    """Nulls and halves. Equal ranges only where the SQL does not depend on their order."""
    c = duckdb.connect()
    c.execute(
        f"""COPY (SELECT CASE WHEN r % 13 <> 0 THEN r % 40 END AS l_orderkey, CASE WHEN r % 7 <> 0 THEN r * 37 % 400 - 100 END AS l_partkey, CASE WHEN r % 6 > 1 THEN r * 11 % 50 WHEN r % 6 = 1 THEN r % 90 / 4.0 END::DOUBLE AS l_quantity FROM range(600) t(r) QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey % 50, l_quantity::BIGINT % 9 ORDER BY r) = 1
          UNION ALL SELECT 900, 5, NULL FROM range(3) UNION ALL SELECT 901, NULL, NULL FROM range(2) UNION ALL SELECT 902, 7, 2.5 UNION ALL SELECT 902, 7, 3.5) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)"""
    )
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    df = QUERIES["merge_ranges"](spark, str(tmp_path))
    c.execute(ORACLES["merge_ranges"])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([d[0] for d in c.description], c.fetchall())
