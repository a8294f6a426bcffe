"""Every registered query over trades against its SQL, on the smallest data."""

import glob
import math
import os

import pytest

from ledgerloom import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float) or hasattr(v, "as_tuple"):
        return f"{float(v):.9g}"
    return f"{v:.9g}" if isinstance(v, int) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    found = duck.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted([plain(v) for v in row] for row in found.fetchall())
    got = sorted([plain(v) for v in row] for row in df.select(*columns).collect())
    assert got == want


def test_without_sql(spark):
    """The baseline learns: its scores tell the train labels apart better than chance."""
    rows = queries.QUERIES["baseline_model_scores"](spark, DATA)
    labels = queries.QUERIES["split_features"](spark, DATA).select("trade_uid", "label_y")
    scored = rows.join(labels, "trade_uid").where("split = 'train'").select("logit", "label_y").toPandas()
    ranks, y = scored["logit"].rank(), scored["label_y"] > 0.5
    assert len(scored) > 100 and (ranks[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum()) > 0.6
