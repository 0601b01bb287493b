"""Every registered query with SQL against DuckDB on the smallest tables; every other one runs and has rows."""

import math
from pathlib import Path

import duckdb
import pytest

import fathomline
from fathomline.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def rows(df):
    value = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(map(value, r)) for r in df[sorted(df.columns)].astype(object).values.tolist()), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "benchmark", "embeddings", "labels", "conversations", "pages"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        assert rows(got) == rows(duck.sql(ORACLES[name]).df())
    else:
        assert len(got)


def test_the_training_data_operators_stand_apart():
    root = Path(fathomline.__file__).parent
    users = [p.name for p in root.rglob("*.py") if p.relative_to(root).parts[0] != "llm" and "fathomline.llm" in p.read_text()]
    assert not users
