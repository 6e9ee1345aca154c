"""Every core query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from quaylight.plans import functions, pages, registry, state, streams, tables  # noqa: F401

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, duck, tmp_path):
    got = registry.QUERIES[name](spark, DATA)
    got.write.parquet(f"{tmp_path}/got")
    if name not in registry.ORACLES:
        assert spark.read.parquet(f"{tmp_path}/got").count() > 0
        return
    duck.sql(f"create or replace table got as select * from '{tmp_path}/got/*.parquet'")
    duck.sql(f"create or replace table want as {registry.ORACLES[name]}")
    columns = sorted(got.columns)
    assert columns == sorted(r[0] for r in duck.sql("describe want").fetchall())
    c = ", ".join(f'"{x}"' for x in columns)
    more = duck.sql(f"select {c} from got except all select {c} from want").fetchall()
    less = duck.sql(f"select {c} from want except all select {c} from got").fetchall()
    assert (more[:3], less[:3]) == ([], [])
