"""The whole study from weekly files, and the readers and sinks it uses."""

from __future__ import annotations

import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from aisleframe.plans import model
from aisleframe.plans.scanner import QUARTERLY, ScannerPlan
from aisleframe.sources import readers, stages

YEARS = range(2009, 2013)
WEEKS = ("0215", "0520", "0815", "1120")


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """Two categories, twelve stores, three chains; one category-year has no file."""
    root = tmp_path_factory.mktemp("scanner")
    rng = random.Random(7)
    total = 0.0
    for category in ("0501", "7035"):
        for year in YEARS:
            if (category, year) == ("7035", 2009):
                continue
            folder = root / "movement" / str(year)
            folder.mkdir(parents=True, exist_ok=True)
            lines = ["upc\tstore_code_uc\tweek_end\tunits\tprmult\tprice\tfeature"]
            for store in range(1, 13):
                for upc in (1, 2, 3):
                    for week in WEEKS:
                        units, price = rng.randint(1, 9), rng.randint(100, 300) / 100
                        lines.append(f"{upc}\t{store}\t{year}{week}\t{units}\t1\t{price}\t0")
                        total += price * units
            (folder / f"{category}_{year}.tsv").write_text("\n".join(lines) + "\n")
    for year in YEARS:
        folder = root / "annual"
        folder.mkdir(exist_ok=True)
        stores = ["store_code_uc\tyear\tparent_code\tfips_state_code\tzip"]
        for s in range(1, 13):
            state = (6, 12, 48)[s % 3] if s <= 8 else (6 if s <= 10 else 12)
            stores.append(f"{s}\t{year}\t{1 if s <= 4 else 2 if s <= 8 else s}\t{state}\tx")
        (folder / f"stores_{year}.tsv").write_text("\n".join(stores) + "\n")
        versions = ["upc\tupc_ver_uc\tpanel_year"] + [f"{u}\t1\t{year}" for u in (1, 2, 3)]
        (folder / f"versions_{year}.tsv").write_text("\n".join(versions) + "\n")
    rates = ["statefips,year,t_x,t_corp,wgt_sales"] + [
        f"{s},{y},{s},{0 if s == 48 else 5},50" for s in (6, 12, 48) for y in YEARS
    ]
    (root / "rates.csv").write_text("\n".join(rates) + "\n")
    return root, total


@pytest.fixture(scope="module")
def plan(spark, files):
    root, _ = files
    extras = spark.createDataFrame(
        [(u, y, "a" if u == 1 else None, u) for u in (1, 2) for y in YEARS],
        "upc long, year int, flavor_code string, size2_code int",
    )
    extras.write.parquet(str(root / "extras"))
    out = ScannerPlan(spark, str(root / "out"))
    out.run(
        str(root / "movement"),
        readers.read_stores(spark, f"{root}/annual/stores_*.tsv"),
        readers.read_upc_versions(spark, f"{root}/annual/versions_*.tsv"),
        readers.read_extras(spark, str(root / "extras")),
        readers.read_tax_rates(spark, str(root / "rates.csv")),
        ["flavor_code", "size_code"],
    )
    return out


def test_categories_keep_leading_zeros_and_missing_files_give_no_rows(spark, plan):
    clean = stages.read_stage(spark, plan.path("clean"), QUARTERLY)
    assert {(r.group, r.year) for r in clean.select("group", "year").distinct().collect()} == {
        (c, y) for c in ("0501", "7035") for y in YEARS if (c, y) != ("7035", 2009)
    }
    assert {r.group for r in readers.categories(clean).collect()} == {"0501", "7035"}


def test_totals_agree_along_the_chain(spark, files, plan):
    _, total = files
    for step in ("clean", "products", "extras", "store_groups", "parents", "uniform"):
        column = "total_revenue" if step == "uniform" else "revenue"
        got = spark.read.parquet(plan.path(step)).agg(F.sum(column)).first()[0]
        assert math.isclose(got, total, rel_tol=1e-12), step


def test_stage_filters_prune_folders(spark, plan):
    clean = stages.read_stage(spark, plan.path("clean"), QUARTERLY).where("`group` = '0501'")
    assert len(clean.inputFiles()) > 0
    plan_text = clean._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(group" in plan_text


def test_results(spark, plan):
    group = spark.read.parquet(plan.path("results_group"))
    assert group.count() == 2 and "r2a_se" in group.columns
    assert group.where("r2_b IS NOT NULL").count() == 2
    pooled = {r.spec: r for r in spark.read.parquet(plan.path("results_pooled")).collect()}
    assert len(pooled) == 13
    stores = spark.read.parquet(plan.path("store_groups")).where("fips_state_code = 6")
    # Sixteen quarters of one category and twelve of the other, which has no first year.
    assert pooled["r1"].n == stores.select("store_code_uc").distinct().count() * 28
    assert spark.read.parquet(plan.path("results_extras")).count() == 2
    assert spark.read.parquet(plan.path("results_hhi")).count() == 2


def test_frequent_items_of_one_category(spark, files, plan):
    root, _ = files
    rates = readers.read_tax_rates(spark, str(root / "rates.csv"))
    panel = plan.frequent_items(rates, "0501", 12 * 16 - 1)
    assert panel.count() == 12 * 16 * 3
    assert plan.frequent_items(rates, "0501", 12 * 16).count() == 0


def test_chunks(spark, plan, tmp_path):
    stages.write_chunks(plan.extras(), str(tmp_path / "chunks"), 3, 2010, 2011)
    out = spark.read.parquet(str(tmp_path / "chunks"))
    assert len(out.inputFiles()) <= 3
    assert {r.year for r in out.select("year").distinct().collect()} == {2010, 2011}


def test_model_tables_round_trip(spark, tmp_path):
    from aisleframe.operators import scenarios
    from aisleframe.sources import schemas

    firms = spark.createDataFrame([(1, 4.0)], "firm_id long, epsilon double")
    constants = {name: 1.0 for name in ("cost", "wage", "rental_rate", "kappa", "alpha", "A", "Lbar",
                                        "sales_weight")}
    constants |= {"rho": float("inf"), "payroll_weight": 0.0, "property_weight": 0.0}
    panel = scenarios.scenario_panel(firms, ((1, 1), (2, 2)), constants, 0.2, 0.1)
    panel = panel.select([F.col(f.name).cast(f.dataType) for f in schemas.FIRM_PANEL.fields])
    readers.write_panel(panel, str(tmp_path / "params"))
    back = readers.read_panel(spark, str(tmp_path / "params"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, panel.collect()))

    solved = back.withColumns({
        "optimal_price": F.lit(1.5), "optimal_quantity_consumed": F.lit(2.0),
        "optimal_quantity_produced": F.lit(2.0), "optimal_state_revenue": F.lit(3.0),
        "optimal_state_cost": F.lit(2.0), "optimal_profits": F.lit(1.0),
        "optimal_state_profits": F.lit(1.0),
    })
    readers.write_panel(solved, str(tmp_path / "solved"))
    tables = model.solved_tables(spark, str(tmp_path / "solved"))
    assert tables["markups"].first().firm_markup == 0.5
    assert tables["prices"].count() == 9 and tables["profits"].count() == 2

    costs = scenarios.trade_costs(back, 0.1, 0.0)
    readers.write_panel(costs.select([f.name for f in schemas.TRADE_COSTS.fields]),
                        str(tmp_path / "costs"))
    assert readers.read_trade_costs(spark, str(tmp_path / "costs")).count() == 5


def test_shared_folder_is_the_one_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    staged = stages.stage_table(spark.range(3), "t")
    assert staged.count() == 3
    assert staged.inputFiles()[0].startswith(f"file://{named}/aisleframe/")


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        stages.shared_dir(Session())


def _staged(spark):
    folder = Path(stages.shared_dir(spark)) / "aisleframe" / spark.sparkContext.applicationId
    return {p.name for p in folder.iterdir()} if folder.exists() else set()


def test_a_scope_drops_its_tables_also_after_a_failure(spark):
    before = _staged(spark)
    with stages.stage_scope(spark):
        outer = stages.stage_table(spark.range(4), "outer")
        with pytest.raises(RuntimeError), stages.stage_scope(spark):
            stages.stage_table(spark.range(2), "inner")
            raise RuntimeError
        assert outer.count() == 4 and len(_staged(spark) - before) == 1
    assert _staged(spark) == before


def test_a_stopped_job_resumes_at_its_unfinished_step(spark, tmp_path):
    ran, fails = [], [True]

    def step(name):
        def job():
            ran.append(name)
            rows = stages.stage_table(spark.range(3), name)
            stages.write_results(rows, str(tmp_path / "out" / name))
            if name == "b" and fails[0]:
                raise RuntimeError("killed after its output was written")
        return job

    before = _staged(spark)
    steps = {name: step(name) for name in "abc"}
    log = stages.StepLog(spark, str(tmp_path / "steps"), "key")
    with pytest.raises(RuntimeError):
        log.run(steps, resume=True)
    assert [log.finished(s) for s in "abc"] == [True, False, False] and _staged(spark) == before
    fails[0] = False
    assert log.run(steps, resume=True) == ["b", "c"] and ran == ["a", "b", "b", "c"]
    assert spark.read.parquet(str(tmp_path / "out" / "b")).count() == 3
    assert log.run(steps, resume=True) == []
    assert stages.StepLog(spark, str(tmp_path / "steps"), "other").run(steps, resume=True) == list("abc")
    assert log.run(steps) == list("abc")


def test_a_study_leaves_only_results_and_resumes(spark, files, plan, tmp_path_factory):
    root, _ = files
    inputs = (
        str(root / "movement"),
        readers.read_stores(spark, f"{root}/annual/stores_*.tsv"),
        readers.read_upc_versions(spark, f"{root}/annual/versions_*.tsv"),
        readers.read_extras(spark, str(root / "extras")),
        readers.read_tax_rates(spark, str(root / "rates.csv")),
        ["flavor_code", "size_code"],
    )
    before = _staged(spark)
    assert plan.run(*inputs, resume=True) == []
    stages.drop_path(spark, plan.path("steps/regressions"))
    assert plan.run(*inputs, resume=True) == ["regressions"]
    assert _staged(spark) == before
    assert not any(name.startswith(("panel", "did", "quantile")) for name in before)
