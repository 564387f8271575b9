"""The same oracle equality with every size bound forced low: two-phase running
totals, row ids and quantiles, and shuffle joins instead of broadcasts -- the
code paths a 100 TB run takes."""

import duckdb
import pytest

from tarmac.plans import ORACLE, QUERIES, load_all
from tarmac.sources.tables import TABLES
from tools.oracle_check import rows_key

from paths import SF_SMALL

load_all()

LARGE_PATH_QUERIES = ["abc_products", "abc_summary", "abc_fact_class", "products_top", "rfm", "rfm_fallback",
                      "dim_product", "dim_customer", "dim_insert_absent", "star_fact_keys", "entity_index",
                      "churn_label", "fill_defaults", "fact_roundtrip"]

FORCED = {"spark.tarmac.smallRows": "10", "spark.tarmac.broadcastRows": "5",
          "spark.sql.autoBroadcastJoinThreshold": "-1"}


@pytest.fixture(scope="module")
def forced(spark):
    old = {k: spark.conf.get(k, None) for k in FORCED}
    for k, v in FORCED.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", LARGE_PATH_QUERIES)
def test_large_path_matches_oracle(forced, con, name):
    sdf = QUERIES[name](forced, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    res = con.execute(ORACLE[name])
    drows = res.fetchall()
    dcols = [c[0] for c in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert rows_key(sdf.columns, srows, False) == rows_key(dcols, drows, False)
