"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

from tests import oracle
from textloom.plans import blocks, books, catalogue, layouts, more

assert blocks and books and more and layouts  # adds to the catalogue
SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
#: Queries that find nothing in the smallest tables.
EMPTY_ON_SMALLEST = {"sentence_zip"}
#: No table has such words; ``test_operators`` has cases of its own.
EMPTY = {"code_shapes"}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    sf_dir = LARGER if name in EMPTY_ON_SMALLEST else SF
    tables = db if sf_dir == SF else oracle.connect(sf_dir)
    assert oracle.compare(spark, tables, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], sf_dir) == ("empty" if name in EMPTY else None)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_components_of_all_rows_equal_union_find(spark):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for row in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey", "l_partkey").collect():
        a, b = sorted((top(row.l_suppkey), top(row.l_suppkey + 1 + row.l_partkey % 3)))
        root[b] = a
    got = [tuple(r) for r in catalogue.QUERIES["connected_components"](spark, SF).select("node", "root").collect()]
    assert sorted(got) == sorted((x, top(x)) for x in root)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
