"""Readers of files whose columns come in different orders."""

from __future__ import annotations

import pytest

from aisleframe.sources import readers


def write(folder, name, *lines):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("".join(f"{line}\n" for line in lines))


def test_each_file_has_its_own_order(spark, tmp_path):
    root = tmp_path / "weeks 2001_1999"
    write(root / "2010", "0501_2010.tsv", "upc\tstore_code_uc\tweek_end\tunits\tprmult\tprice", "1\t2\t20100102\t3\t1\t0.5")
    write(root / "2011", "0501_2011.tsv", "price\tother\tprmult\tunits\tweek_end\tstore_code_uc\tupc",
          "1.5\tx\t2\t4\t20110108\t20\t10", "\tx\t2\t4\t20110108\t21\t10")
    write(root / "7035_2010.tsv", "part-0.csv", "week_end\tupc\tstore_code_uc\tunits\tprmult\tprice", "20100109\t5\t6\t7\t1\t2")
    write(root / "2012", "0501_2012.tsv", "upc\tstore_code_uc\tweek_end\tunits\tprmult\tprice")
    (root / "2012" / "0502_2012.tsv").write_text("")
    got = readers.read_movement(spark, str(root)).collect()
    assert sorted((r.group, r.year, r.store_code_uc, r.upc, r.week_end, r.units, r.prmult, r.price or 0) for r in got) == [
        ("0501", 2010, 2, 1, 20100102, 3.0, 1.0, 0.5), ("0501", 2011, 20, 10, 20110108, 4.0, 2.0, 1.5),
        ("0501", 2011, 21, 10, 20110108, 4.0, 2.0, 0), ("7035", 2010, 6, 5, 20100109, 7.0, 1.0, 2.0)]


def test_one_scan_for_each_layout(spark, tmp_path):
    for year in range(2000, 2010):
        names = ["store_code_uc", "year", "parent_code", "fips_state_code"]
        write(tmp_path, f"stores_{year}.tsv", "\t".join(names if year % 2 else names[::-1]), "\t".join(["1"] * 4))
    stores = readers.read_stores(spark, str(tmp_path))
    assert stores.count() == 10
    plan = stores._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2


def test_missing_column_names_the_file(spark, tmp_path):
    write(tmp_path, "versions_2001.tsv", "upc\tpanel_year", "1\t2001")
    with pytest.raises(ValueError, match="versions_2001.tsv has no column upc_ver_uc"):
        readers.read_upc_versions(spark, str(tmp_path))


def test_malformed_number_and_empty_folder(spark, tmp_path):
    write(tmp_path / "bad", "stores_2001.tsv", "store_code_uc\tyear\tparent_code\tfips_state_code", "x1\t2001\t1\t6")
    with pytest.raises(Exception, match="store_code_uc is no bigint: x1"):
        readers.read_stores(spark, str(tmp_path / "bad")).collect()
    write(tmp_path / "none", "stores_2001.tsv")
    assert readers.read_stores(spark, str(tmp_path / "none")).count() == 0
