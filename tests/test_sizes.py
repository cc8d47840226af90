"""What the optimizer takes for small is small: no join side is unfolded to a row per product and year."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import DataFrameWriter

from aisleframe.operators import collapse, joins
from catalog.queries import QUERIES

YEARLY = [
    "product_panel", "did_by_bin", "did_by_group_extras", "extras_collapse", "uniform_price",
    "frequent_groups", "hhi_bin_panel", "hhi_bins", "price_concentration", "store_group_collapse",
    "hhi_bin_panel_reports", "hhi_bins_extras", "exposure_panel_extras",
]


def _plan(df) -> list[str]:
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def _unfolded(plan: list[str]) -> list[str]:
    """Columns of the tables that are unfolded below a join."""
    if not any(" Join " in line or line.startswith("Join ") for line in plan):
        return []
    starts = [i for i, line in enumerate(plan) if "Generate explode" in line]
    return [next(line for line in plan[i:] if "Relation [" in line) for i in starts]


@pytest.mark.parametrize("name", YEARLY)
def test_stores_and_products_are_not_unfolded_by_year_below_a_join(spark, monkeypatch, name):
    plans, write = [], DataFrameWriter.parquet

    def watched(self, *args, **kw):
        plans.append(_plan(self._df))
        return write(self, *args, **kw)

    monkeypatch.setattr(DataFrameWriter, "parquet", watched)
    plans.append(_plan(QUERIES[name](spark, "/root/testdata/sf0.001")))
    found = [line for plan in plans for line in _unfolded(plan)]
    assert [line for line in found if re.search("p_partkey|s_suppkey", line)] == []
    assert any(re.search("_held", line) for plan in plans for line in plan)


def test_a_folded_table_has_a_row_for_each_change(spark, rows):
    y = spark.createDataFrame(
        [(1, year, 1 if year < 2003 else 2) for year in range(1996, 2007) if year != 1999] + [(2, None, 3)],
        "upc int, year int, ver int",
    )
    folded = joins.fold_periods(y, ["upc", "year"], ["ver"], "year")
    bits = [sum(1 << year % 32 for year in span if year != 1999) for span in (range(1996, 2003), range(2003, 2007))]
    assert rows(folded, "upc", "ver", "_held") == [(1, 1, (62 << 32) + bits[0]), (1, 2, (62 << 32) + bits[1]), (2, 3, None)]


def test_folded_join_is_the_join_by_year(spark, rows):
    """Gaps, changes back and forth, blocks of 64 years, missing keys, missing years, kept old values."""
    values = {1: "aabba", 2: "a-a-a", 3: "-----", None: "b--bb"}
    years = [1982, 1983, 1984, 2047, 2048]
    y = spark.createDataFrame(
        [(k, year, v) for k, vs in values.items() for year, v in zip(years, vs, strict=True) if v != "-"]
        + [(1, None, "n"), (2, -1, "m"), (2, 1985, None)], "k int, year int, v string")
    x = spark.createDataFrame(
        [(k, year, "old") for k in (1, 2, 3, 4, None) for year in (*years, 1985, None, -1, 0, 63, 64)] * 2,
        "k int, year int, v string")
    plain = joins.update_join(x, y, ["k", "year"], {"v": "v", "w": "v"}, unique=True)
    folded = joins.update_join(x, y, ["k", "year"], {"v": "v", "w": "v"}, unique=True, period="year")
    assert rows(folded, "k", "year", "v", "w") == rows(plain, "k", "year", "v", "w")
    assert folded.columns == plain.columns


def test_last_report_of_a_year_counts_when_folded(spark, rows):
    versions = spark.createDataFrame([(7, 2010, 1, 1), (7, 2010, 4, 2), (7, 2011, 1, 2)],
                                     "upc long, year int, quarter int, upc_ver_uc int")
    sold = spark.createDataFrame([(7, 2010), (7, 2011), (7, 2012), (8, 2010)], "upc long, year int")
    out = collapse.attach_versions(sold, versions, order=["quarter"])
    assert rows(out, "upc", "year", "upc_ver_uc") == [(7, 2010, 2), (7, 2011, 2), (7, 2012, None), (8, 2010, None)]
