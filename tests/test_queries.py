import duckdb
import pandas as pd
import pytest

from textloom.plans import functions, segmentation, sources, streams  # noqa: F401
from textloom.plans import queries as plans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "events", "orders", "lineitem", "part"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = plans.QUERIES[name](spark, SF).toPandas(), con.execute(plans.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    text = lambda df: sorted("|".join(str(v.tolist()) if hasattr(v, "tolist") and getattr(v, "ndim", 0) else "-" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert text(got) == text(want)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_rows(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0
