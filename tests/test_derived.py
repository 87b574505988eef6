"""Occurrences derived from order tables of a few rows."""

from datetime import datetime

import pytest

from wildtally import derived

DAY = datetime(1997, 1, 2)
TABLES = {
    "region": ("r_regionkey int, r_name string", [(0, "ASIA"), (1, None)]),
    "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "JAPAN", 0), (1, "PERU", 1)]),
    "supplier": ("s_suppkey long, s_nationkey int", [(1, 0), (2, 1), (3, None)]),
    "part": (
        "p_partkey long, p_name string, p_brand string, p_type string",
        [(1, "tin cup", "Brand#1", "PROMO"), (2, None, "Brand#2", "STANDARD"), (2, "nut", None, None)],
    ),
    "orders": ("o_orderkey long, o_orderdate timestamp", [(1, DAY), (2, DAY), (2, None), (None, DAY)]),
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_shipdate timestamp",
        [(1, 1, 1, 1, "A", DAY), (1, 2, 2, 2, "N", DAY), (2, 1, 2, 1, None, None), (None, 1, 1, 1, "A", DAY), (2, 1, 3, 2, "A", DAY), (3, 1, 1, 1, "A", DAY)],
    ),
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("orders"))
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/{name}.parquet")
    return root


def test_rows(spark, folder):
    found = sorted((r.id, r.taxon, r.start is None, r.source) for r in derived.occurrences(spark, folder).collect())
    assert found == [
        ("1-1", "ASIA|PROMO|Brand#1|tin cup", False, "gbif"),
        ("1-2", "STANDARD|Brand#2", False, "idigbio"),
        ("1-2", "nut", False, "idigbio"),
        ("2-1", "PROMO|Brand#1|tin cup", False, "inaturalist"),
        ("2-1", "PROMO|Brand#1|tin cup", True, "inaturalist"),
    ]


def test_keys_are_spread_and_no_text(spark, folder, monkeypatch):
    seen, frame = [], type(spark.range(1))
    spread = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda rows, *by: seen.append(rows.columns) or spread(rows, *by))
    monkeypatch.setattr(derived, "_written", {})
    derived.occurrences(spark, folder)
    assert seen and not [c for c in seen if "taxon" in c or "p_name" in c]
