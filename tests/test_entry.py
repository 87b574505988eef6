"""The registered queries: each has SQL, and they run without Python in the plan."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver

FOLDER = "/root/testdata/sf0.001"
CHEAP = ["checklist_topk", "polygon_hole_filter", "added_between", "selector_pick", "taxon_names", "generate_occurrences"]


def test_all_queries_have_sql():
    assert set(driver.registry.queries()) == set(driver.ORACLES)
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry_without_the_text_part():
    """A package that only the text operators need may be missing: all other queries stay."""
    for missing in ("ahocorasick", "corpus_pipeline", "wildtally.llm"):
        code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
        out = subprocess.run([sys.executable, "-c", code], cwd=Path(driver.__file__).parent, capture_output=True, text=True, check=True)
        known = len(driver.registry.queries())
        assert out.stdout.split() == [str(known), str(known)]


def test_entry(spark):
    rows = driver.entry(spark)
    assert rows.columns == ["taxonPath", "recordCount"] and rows.count() == 20


@pytest.mark.parametrize("name", CHEAP)
def test_equal_to_sql(spark, name):
    db = duckdb.connect()
    for table in "region nation supplier part orders lineitem".split():
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    result = driver.queries()[name](spark, FOLDER)
    rows = db.execute(driver.oracle_sql()[name])
    names = [c[0] for c in rows.description]
    assert sorted(names) == sorted(result.columns)
    theirs = sorted(repr(tuple(r)) for r in rows.fetchall())
    assert sorted(repr(tuple(r)) for r in result.select(*names).collect()) == theirs


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    queries = driver.queries()
    # A box and an added range reach the scan as plain comparisons.
    from wildtally.operators import filters

    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    path = spark.read.parquet(f"{FOLDER}/orders.parquet").selectExpr("o_orderkey AS added", "o_totalprice AS lat", "o_totalprice AS lng")
    text = plan(filters.added_filter(filters.area_filter(path, "ENVELOPE(-150,-50,40,10)"), "1997-01-01"))
    pushed = text.split("PushedFilters")[1]
    for limit in ("o_totalprice,-150.0", "o_totalprice,10.0", "o_orderkey,852163200000"):
        assert f"GreaterThanOrEqual({limit})" in pushed
    matched = plan(queries["match_all_selectors"](spark, FOLDER))
    # Cells and keys in use cut the records down before the selectors are joined, all without a shuffle of records.
    assert "BroadcastHashJoin [_key" in matched and "[_cell#" in matched and matched.count("LeftSemi") == 2
    assert "NestedLoop" not in matched and "Cartesian" not in matched and "SortMergeJoin" not in matched
    for name in ("occurrence_urls", "generate_checklist", "match_all_selectors", "selector_valid"):
        text = plan(queries[name](spark, FOLDER))
        assert "Python" not in text and "Pandas" not in text
