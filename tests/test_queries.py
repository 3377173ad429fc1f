"""Every registered query of the price engine against its SQL, at the smallest size."""

from __future__ import annotations

import pytest

from pricelake import catalog

from .conftest import SMALL, cells

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def _rows(duck, sql: str) -> int:
    return duck.execute(sql).fetchone()[0]


def _groups(got, duck) -> bool:
    """Each offer once, in a group of its query that has the size said and is named after one of its offers."""
    sizes = got.groupby(["query", "group_id"])["offer_id"].transform("count")
    alone = got["size"] == 1
    return not got.duplicated(["query", "offer_id"]).any() and (sizes == got["size"]).all() and set(got["group_id"]) <= set(got["offer_id"]) and got.loc[alone, "confidence"].isna().all() and got.loc[~alone, "score"].ge(0.75).all()


def _intervals(got, duck) -> bool:
    return set(got["statistic"]) == {"precision", "recall", "label_precision"} and (got.dropna()["low"] <= got.dropna()["high"]).all()


#: What holds of the queries that SQL can't state; tests/test_rules.py compares their operators with brute force.
HOLDS = {
    "group_equivalent_offers": _groups,
    "bootstrap_intervals": _intervals,
    "pelt_drop_flag": lambda got, duck: len(got) == got["seq"].nunique() == _rows(duck, "SELECT count(*) FROM events") and 0 < got["pelt_flag"].sum() < len(got) / 2,
    "isolation_forest": lambda got, duck: len(got) > 0 and got["score"].between(-1, 0).all() and got["score"].nunique() > 10,
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    if name not in SQL:
        assert HOLDS[name](got, duck)
        return
    want = duck.execute(SQL[name]).df()
    assert cells(got) == cells(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
