"""Every query with oracle SQL equals DuckDB on the same parquet tables (sf0.001).

Same comparison as the driver: columns by name, rows as multisets, values exact
(floats are compared exactly; all money is summed exactly on both sides).
"""

import duckdb
import pytest

from tarmac.plans import ORACLE, QUERIES, load_all
from tarmac.sources.tables import TABLES
from tools.oracle_check import rows_key

from paths import SF_SMALL

load_all()

# Spark simple type -> DuckDB type name
TYPE_FAMILY = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
               "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    con.execute(f"CREATE OR REPLACE TEMP VIEW result AS {ORACLE[name]}")  # the SQL must work as a view
    rel = con.sql(ORACLE[name])
    dtypes = dict(zip(rel.columns, [str(t) for t in rel.types]))
    res = con.execute(ORACLE[name])
    drows = res.fetchall()
    dcols = [c[0] for c in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    for f in sdf.schema.fields:
        assert TYPE_FAMILY.get(f.dataType.simpleString()) == dtypes[f.name], (f.name, f.dataType, dtypes[f.name])
    assert len(srows) == len(drows)
    assert rows_key(sdf.columns, srows, False) == rows_key(dcols, drows, False)
