"""Every operator run over the whole order tables, one query per key."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aisleframe.functions.scalars import demand, inverse_demand, markup_price, year_quarter
from aisleframe.operators import (
    apportionment, collapse, exposure, joins, pricing, regression, reports, reshape, scenarios, specs,
    taxes,
)
from aisleframe.plans import model
from aisleframe.sources import mapping as m
from aisleframe.sources import readers, schemas
from aisleframe.sources.stages import read_stage, shared_dir, stage_table, write_stage
from catalog.digits import EDGE, digits_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

EGGS = "ECONOMY"
SCENARIOS = ((0, 4), (1, 1), (2, 3), (3, 4), (4, 6), (5, 12), (6, 40))


def _rounded(column: str):
    scale = 10.0 ** digits_of(column)
    return (F.floor(F.col(column) * scale + EDGE) / scale).alias(column)


def query(f: Query) -> Query:
    """Register under the function's name; doubles are rounded for comparison."""
    def rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(spark, sf_dir)
        return df.select([
            _rounded(c.name) if isinstance(c.dataType, T.DoubleType) else F.col(c.name)
            for c in df.schema.fields
        ])

    QUERIES[f.__name__] = rounded
    return f


# --- panel -------------------------------------------------------------------------------------

@query
def stores_dim(spark, sf_dir):
    return m.stores(spark, sf_dir)


@query
def upc_versions(spark, sf_dir):
    return m.upc_versions(spark, sf_dir)


@query
def categories(spark, sf_dir):
    return readers.categories(m.quarterly(spark, sf_dir))


# --- the same tables through their input files --------------------------------------------------

def _folder(spark, name):
    return f"{shared_dir(spark)}/aisleframe/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _as_files(df: DataFrame, name: str, year: str, tag: str) -> str:
    """The rows as tab-separated files, a folder for each tag; odd years have their columns in another order
    and a further column."""
    folder = _folder(df.sparkSession, name)
    rows = df.withColumn("file", F.expr(tag)).hint("rebalance", "file")
    columns = df.columns
    layouts = ([*columns], [*columns[::-1], "unused"])
    for odd, layout in enumerate(layouts):
        rows.withColumn("unused", F.lit("x")).where(f"({year}) % 2 = {odd}").select(*layout, "file").write.partitionBy(
            "file").csv(f"{folder}/{odd}", sep="\t", header=True)
    return folder


@query
def movement_files(spark, sf_dir):
    """All weekly rows written by category and year and read back, then what each file held."""
    weeks = m.with_group(m.movement(spark, sf_dir), spark, sf_dir)
    code = "lpad(string(ascii(`group`) * 100 + length(`group`)), 4, '0')"
    rows = weeks.withColumn("code", F.expr(code)).drop("group")
    folder = _as_files(rows, "movement", "week_end div 10000", "concat(code, '_', week_end div 10000)")
    return readers.read_movement(spark, folder).groupBy("group", "year").agg(
        F.count("*").alias("n_rows"), F.countDistinct("store_code_uc").alias("n_stores"),
        F.countDistinct("upc").alias("n_products"), F.sum("units").cast("long").alias("units"),
        F.round(F.sum(F.col("price") * 100)).cast("long").alias("cents"),
        F.sum("prmult").cast("long").alias("multiples"), F.min("week_end").alias("first_week"),
        F.max("week_end").alias("last_week"))


@query
def movement_file_quarter(spark, sf_dir):
    """Store x product x quarter from the files of all categories and years."""
    weeks = m.with_group(m.movement(spark, sf_dir), spark, sf_dir).withColumn("code", F.expr(
        "lpad(string(ascii(`group`) * 100 + length(`group`)), 4, '0')")).drop("group")
    folder = _as_files(weeks, "movement", "week_end div 10000", "concat(code, '_', week_end div 10000)")
    return collapse.movement_quarter(readers.read_movement(spark, folder).drop("group"))


@query
def store_files(spark, sf_dir):
    folder = _as_files(m.stores(spark, sf_dir), "stores", "year", "string(year)")
    return readers.read_stores(spark, folder)


@query
def upc_version_files(spark, sf_dir):
    versions = m.upc_versions(spark, sf_dir).withColumnRenamed("year", "panel_year")
    return readers.read_upc_versions(spark, _as_files(versions, "versions", "panel_year", "string(panel_year)"))


@query
def extras_file(spark, sf_dir):
    """Of two size codes the second is the one in use."""
    folder = _folder(spark, "extras")
    extras = m.extras(spark, sf_dir).withColumnRenamed("size_code", "size2_code")
    extras.withColumn("size_code", F.lit(-1)).write.parquet(folder)
    return readers.read_extras(spark, folder).select("upc", "year", "group", "flavor_code", "size_code")


@query
def trade_cost_file(spark, sf_dir):
    """Trade costs of the observed flows through their CSV file."""
    folder = _folder(spark, "trade-costs")
    readers.write_panel(m.trade_flows(spark, sf_dir).select(schemas.TRADE_COSTS.fieldNames()), folder)
    return readers.read_trade_costs(spark, folder)


@query
def movement_quarter(spark, sf_dir):
    return collapse.movement_quarter(m.movement(spark, sf_dir))


def _extras(spark, sf_dir, years=None, together=()):
    """One exchange by store and quarter serves all sums up to the store's groups."""
    quarterly = m.quarterly(spark, sf_dir, years, m.STORE_QUARTER)
    placed = collapse.attach_stores(quarterly, m.stores(spark, sf_dir), unique=True)
    return collapse.extras_collapse(placed, m.extras(spark, sf_dir), m.ATTRIBUTES, unique=True, together=together)


@query
def product_panel(spark, sf_dir):
    quarterly = m.quarterly(spark, sf_dir)
    return collapse.product_panel(
        quarterly, m.stores(spark, sf_dir), m.upc_versions(spark, sf_dir), unique=True
    )


@query
def product_panel_reports(spark, sf_dir):
    """Dimension tables with several reports a year: the last quarter's counts."""
    return collapse.product_panel(m.quarterly(spark, sf_dir), m.store_reports(spark, sf_dir),
                                  m.version_reports(spark, sf_dir), order=["quarter"])


@query
def extras_collapse_reports(spark, sf_dir):
    """Attribute table with several rows for a product's year and no order: the largest values count."""
    placed = collapse.attach_stores(m.quarterly(spark, sf_dir), m.stores(spark, sf_dir), unique=True)
    return collapse.extras_collapse(placed, m.extras_reports(spark, sf_dir), m.ATTRIBUTES)


@query
def extras_groups(spark, sf_dir):
    return collapse.extras_groups(m.extras(spark, sf_dir), m.ATTRIBUTES)


@query
def extras_collapse(spark, sf_dir):
    return _extras(spark, sf_dir)


@query
def store_group_collapse(spark, sf_dir):
    return collapse.store_group_collapse(_extras(spark, sf_dir))


@query
def stage_round_trip(spark, sf_dir):
    """The category panel written by category and year and read back."""
    path = f"{shared_dir(spark)}/aisleframe/{spark.sparkContext.applicationId}/store-groups-" \
        f"{uuid.uuid4().hex}"
    panel = m.store_groups(spark, sf_dir)
    write_stage(panel, path)
    return read_stage(spark, path, panel.schema)


@query
def parent_state(spark, sf_dir):
    return m.parents(spark, sf_dir)


@query
def frequent_groups(spark, sf_dir):
    """Groups are counted over all years, then cut to the window."""
    panel = stage_table(_extras(spark, sf_dir), "extras")
    return collapse.frequent_groups(panel, 60).where(F.col("year").between(*m.WINDOW))


# --- uniform prices ----------------------------------------------------------------------------

def _uniform(spark, sf_dir, window=m.WINDOW):
    return pricing.uniform_price(_extras(spark, sf_dir, window, pricing.UNIFORM_KEYS), digits=-2)


@query
def uniform_price(spark, sf_dir):
    return _uniform(spark, sf_dir, None)


@query
def price_concentration(spark, sf_dir):
    return pricing.price_concentration(_uniform(spark, sf_dir))


@query
def hhi_bins(spark, sf_dir):
    return pricing.hhi_bins(_uniform(spark, sf_dir))


@query
def hhi_bins_extras(spark, sf_dir):
    return pricing.hhi_bins(_uniform(spark, sf_dir), ("group", "extras_group"))


@query
def hhi_bin_panel(spark, sf_dir):
    bins = pricing.hhi_bins(_uniform(spark, sf_dir))
    panel = m.store_groups(spark, sf_dir, m.WINDOW)
    return joins.update_join(panel, bins, ["group"], ["hhi_bin"], unique=True)


@query
def hhi_bin_panel_reports(spark, sf_dir):
    """Bins of a category's extras groups on the category: that of the most concentrated one counts."""
    bins = pricing.hhi_bins(_uniform(spark, sf_dir), ("group", "extras_group"))
    panel = m.store_groups(spark, sf_dir, m.WINDOW)
    return joins.update_join(panel, bins, ["group"], ["hhi_bin"], order=["hhi"])


# --- taxes and exposure ------------------------------------------------------------------------

@query
def tax_changes(spark, sf_dir):
    return taxes.tax_changes(m.tax_rates(spark, sf_dir), m.WINDOW[0])


@query
def sales_weight_changes(spark, sf_dir):
    return taxes.sales_weight_changes(m.tax_rates(spark, sf_dir), m.WINDOW[0])


def _flags(spark, sf_dir, years=None):
    return exposure.exposure_flags(m.parents(spark, sf_dir, years), m.FOCAL, m.OTHER_STATES)


@query
def exposure_flags(spark, sf_dir):
    return _flags(spark, sf_dir)


def _exposure(spark, sf_dir, extra=(), items=False, collapsed=None):
    """Panel of the study window; the staged panel serves the parents as well, which are written so
    that their size is known when they are joined back."""
    if collapsed is None:
        collapsed = (_extras if items else m.store_groups)(spark, sf_dir, m.WINDOW)
    panel = stage_table(collapsed, "panel")
    parents = stage_table(collapse.parent_state(panel), "parents")
    flags = exposure.exposure_flags(parents, m.FOCAL, m.OTHER_STATES)
    zero = taxes.zero_tax_states(m.statutory_rates(spark, sf_dir), m.CUTOFF)
    series = ("store_code_uc", "group", "extras_group") if items else ("store_code_uc", "group")
    return exposure.exposure_panel(
        panel, flags, zero, m.BASE, m.CUTOFF, series, ("store_code_uc", "group"), extra
    )


@query
def exposure_panel(spark, sf_dir):
    return _exposure(spark, sf_dir)


@query
def exposure_panel_extras(spark, sf_dir):
    return _exposure(spark, sf_dir, items=True)


@query
def baseline_log_change(spark, sf_dir):
    panel = m.store_groups(spark, sf_dir, m.WINDOW)
    return exposure.baseline_log_change(panel, m.BASE)


# --- reports -----------------------------------------------------------------------------------

@query
def parent_summary(spark, sf_dir):
    return reports.parent_summary(_flags(spark, sf_dir), m.FOCAL)


@query
def focal_spillover(spark, sf_dir):
    return reports.focal_spillover(_flags(spark, sf_dir), m.FOCAL)


@query
def focal_sales_mix(spark, sf_dir):
    return reports.focal_sales_mix(_flags(spark, sf_dir), m.tax_rates(spark, sf_dir), m.BASE, 1997)


@query
def one_way_table(spark, sf_dir):
    panel = _exposure(spark, sf_dir).where(F.col("fips_state_code") == m.FOCAL)
    return reports.one_way_table(panel, ["group", "year", "quarter"], "only_in_focal")


@query
def two_way_table(spark, sf_dir):
    chains = reports.first_store_rows(
        _exposure(spark, sf_dir, extra=("in_state_12",)),
        ["group", "year", "quarter", "parent_code"], ["in_focal", "in_state_12"],
    )
    return reports.two_way_table(chains, "in_focal", "in_state_12", ["group", "year", "quarter"])


@query
def distinct_counts(spark, sf_dir):
    here = F.col("fips_state_code") == m.FOCAL
    there = F.col("fips_state_code") == 12
    only = F.col("only_in_focal") == 1
    return reports.distinct_counts(_exposure(spark, sf_dir), ["group"], {
        "stores": (here, "store_code_uc"),
        "stores_only": (here & only, "store_code_uc"),
        "stores_not_only": (here & ~only, "store_code_uc"),
        "parents": (here, "parent_code"),
        "parents_only": (here & only, "parent_code"),
        "parents_not_only": (here & ~only, "parent_code"),
        "parents_there": (there, "parent_code"),
        "parents_there_exposed": (there & (F.col("in_focal") == 1), "parent_code"),
    })


@query
def filtered_means(spark, sf_dir):
    panel = stage_table(_exposure(spark, sf_dir), "exposure")
    tagged = reports.tag_first_store(panel, ["group", "year", "quarter", "parent_code"])
    here = F.col("fips_state_code") == m.FOCAL
    there = F.col("fips_state_code") == 12
    only, exposed = F.col("only_in_focal") == 1, F.col("in_focal") == 1
    before = F.col("year") == m.CUTOFF - 1
    base = before & (F.col("quarter") == m.BASE[1]) & (F.col("parent_quarter_tag") == 1)
    return reports.filtered_means(tagged, ["group"], {
        "price_only": (before & here & only, "price"),
        "price_not_only": (before & here & ~only, "price"),
        "revenue_only": (base & here & only, "gross_revenue"),
        "revenue_not_only": (base & here & ~only, "gross_revenue"),
        "revenue_there_exposed": (base & there & exposed, "gross_revenue"),
        "revenue_there_other": (base & there & ~exposed, "gross_revenue"),
    })


@query
def median_split(spark, sf_dir):
    panel = stage_table(_exposure(spark, sf_dir), "exposure")
    return reports.median_split(panel, m.BASE).select(
        "group", "store_code_uc", "year", "quarter", "share_base", "median_share", "above_median"
    )


@query
def store_appearances(spark, sf_dir):
    return reports.store_appearances(
        m.store_groups(spark, sf_dir, m.WINDOW), ["store_code_uc", "group"]
    )


@query
def appearance_table(spark, sf_dir):
    return reports.appearance_table(m.store_groups(spark, sf_dir), ["group"])


@query
def store_persistence(spark, sf_dir):
    """Stores count as present in the quarters in which they sell anything."""
    active = m.store_groups(spark, sf_dir).select(
        "store_code_uc", "parent_code", "fips_state_code", "year", "quarter"
    ).distinct().withColumn("yearqtr", year_quarter())
    return reports.store_persistence(active, period="yearqtr")


@query
def stores_in_state(spark, sf_dir):
    active = m.store_groups(spark, sf_dir).select(
        "store_code_uc", "year", "parent_code", "fips_state_code"
    ).distinct()
    return reports.stores_in_state(active)


# --- regressions -------------------------------------------------------------------------------

POOLED = {s.name: s for s in specs.pooled_specs(m.CUTOFF, focal=m.FOCAL)}


def _single(name: str) -> Query:
    def run(spark, sf_dir):
        return regression.fe_did(_exposure(spark, sf_dir), [POOLED[name]])

    run.__name__ = f"did_{name}"
    return run


for _name in POOLED:
    query(_single(_name))


@query
def did_pooled(spark, sf_dir):
    return regression.fe_did(_exposure(spark, sf_dir), list(POOLED.values()))


CATEGORY = specs.category_specs(m.CUTOFF, focal=m.FOCAL)


@query
def did_by_group(spark, sf_dir):
    return regression.fe_did(_exposure(spark, sf_dir), CATEGORY, ["group"])


@query
def did_by_group_extras(spark, sf_dir):
    items = specs.category_specs(m.CUTOFF, ("extras_group",), focal=m.FOCAL)
    return regression.fe_did(_exposure(spark, sf_dir, items=True), items, ["group"])


@query
def did_by_bin(spark, sf_dir):
    """Panel and prices come from one staged collapse of the line items."""
    items = stage_table(_extras(spark, sf_dir, m.WINDOW), "extras")
    panel = _exposure(spark, sf_dir, collapsed=collapse.store_group_collapse(items))
    bins = pricing.hhi_bins(pricing.uniform_price(items.repartition(*pricing.UNIFORM_KEYS), digits=-2))
    binned = joins.update_join(panel, bins, ["group"], ["hhi_bin"], unique=True)
    return regression.fe_did(
        binned, specs.flag_specs(m.CUTOFF, ("group",), focal=m.FOCAL), ["hhi_bin"]
    )


@query
def did_single_category(spark, sf_dir):
    return regression.fe_did(
        _exposure(spark, sf_dir), specs.single_category_specs(m.CUTOFF, m.FOCAL), ["group"]
    )


@query
def did_demeaned(spark, sf_dir):
    panel = _exposure(spark, sf_dir).where(
        (F.col("fips_state_code") != m.FOCAL) & F.col("dlprice_pre").isNotNull()
    ).select(
        "store_code_uc", "group", "yearqtr", "dlprice_pre", "in_focal",
        (F.col("in_focal") * (F.col("year") >= m.CUTOFF).cast("int")).alias("post_in_focal"),
    )
    return regression.demean(
        stage_table(panel, "exposure"), ["dlprice_pre", "in_focal", "post_in_focal"],
        ["group", "yearqtr"],
    )


@query
def results_wide(spark, sf_dir):
    long = did_by_group(spark, sf_dir)
    return reshape.results_wide(long, [s.name for s in CATEGORY])


# --- model panels ------------------------------------------------------------------------------

@query
def panel_merge(spark, sf_dir):
    rates = m.statutory_rates(spark, sf_dir).withColumnRenamed("statefips", "state")
    sizes = m.firms(spark, sf_dir).select("firm_id", "kappa")
    merged = joins.merge(m.chain_revenue(spark, sf_dir), rates, ["state", "year"])
    return joins.merge(merged, sizes, ["firm_id"])


@query
def state_year_grid(spark, sf_dir):
    places = m.chain_revenue(spark, sf_dir).select("firm_id", "state").distinct()
    return joins.expand_values(places, "year", (2010, 2011))


@query
def trade_pairs(spark, sf_dir):
    return scenarios.trade_costs(m.chain_revenue(spark, sf_dir), 0.05, 0.01)


@query
def scenario_panel(spark, sf_dir):
    return scenarios.scenario_panel(
        m.firms(spark, sf_dir).drop("cost"), SCENARIOS,
        {"cost": 100.0, "wage": 0.5, "rental_rate": 0.2, "sales_weight": 1.0},
        base_rate=0.25, increase=0.1,
    )


@query
def rate_sweep(spark, sf_dir):
    return scenarios.rate_sweep(m.firms(spark, sf_dir))


@query
def rate_update(spark, sf_dir):
    """Firm panel whose rate is replaced where a newer rate is known."""
    newer = m.statutory_rates(spark, sf_dir).where(
        (F.col("year") >= m.CUTOFF) & (F.col("statefips") % 4 == 2)
    ).select(F.col("statefips").alias("state"), "year", (F.col("t_corp") + 0.01).alias("tax_rate"))
    return scenarios.set_rates(m.firm_panel(spark, sf_dir), newer, ["state", "year"], "tax_rate")


@query
def conditional_update(spark, sf_dir):
    raised = (F.col("state") == m.FOCAL) & (F.col("year") >= m.CUTOFF)
    return reshape.conditional_update(
        m.firm_panel(spark, sf_dir), raised, {"tax_rate": F.col("tax_rate") + 0.04}
    )


@query
def repeat_rows(spark, sf_dir):
    """One jurisdiction per store of the chain in the state."""
    counts = m.stores(spark, sf_dir).where(F.col("year") == 2000).groupBy(
        "parent_code", "fips_state_code"
    ).agg(F.count(F.lit(1)).cast("int").alias("n_stores"))
    return joins.repeat_rows(counts, "n_stores", "jurisdiction")


@query
def kappa_calibration(spark, sf_dir):
    return scenarios.kappa_calibration(m.firm_panel(spark, sf_dir))


@query
def scaled_revenue(spark, sf_dir):
    """A firm's revenue spread over states as their total sales are."""
    return scenarios.scaled_revenue(
        m.chain_revenue(spark, sf_dir).groupBy("state", "year").agg(F.sum("revenue").alias("spending")),
        "spending", 420000, 9000000,
    )


def _counterfactuals(spark, sf_dir):
    return apportionment.counterfactual_prices(m.solved_panel(spark, sf_dir))


@query
def counterfactual_prices(spark, sf_dir):
    kept = [f"{r}_{what}" for r in apportionment.REGIMES
            for what in ("price", "quantity", "revenue", "state_profits", "sales_share",
                         "state_tax_bill")]
    return _counterfactuals(spark, sf_dir).select(
        "firm_id", "state", "year", *kept, "sales_tax_producer_price", "sales_tax_consumer_price",
        "sales_tax_quantity", "sales_tax_profits",
    )


@query
def profit_comparison(spark, sf_dir):
    return apportionment.profit_comparison(_counterfactuals(spark, sf_dir))


@query
def regime_long(spark, sf_dir):
    regimes = {r: f"{r}_price" for r in apportionment.REGIMES}
    return reshape.regime_long(_counterfactuals(spark, sf_dir), ["firm_id", "state", "year"], regimes)


@query
def markup_table(spark, sf_dir):
    return apportionment.markup_table(m.solved_panel(spark, sf_dir)).select(
        "firm_id", "state", "year", "optimal_price", "optimal_quantity_consumed",
        "total_firm_revenue", "total_firm_cost", "total_firm_sales_quantity", "state_markup",
        "firm_markup", "firm_weighted_markup",
    )


@query
def distortion_table(spark, sf_dir):
    return apportionment.distortion_table(
        m.solved_panel(spark, sf_dir),
        [f"{n} Countries" for n in (1, 2, 3, 5, 10, 50)] + ["Equivalent Sales Tax"],
        {1995: "Equivalent Sales Tax"}, "Country with Higher Taxes", m.FOCAL,
    ).select("firm_id", "state", "year", "n_states", "year_descr", "state_descr", "price_to_plot",
             "year_order")


@query
def separate_accounting(spark, sf_dir):
    return apportionment.separate_accounting(m.solved_panel(spark, sf_dir), 1995, m.FOCAL).select(
        "firm_id", "state", "year", "optimal_price"
    )


@query
def relabel_union(spark, sf_dir):
    """Firms' prices, with a copy of the focal state's rows under another name."""
    return apportionment.sweep_distortion(m.solved_panel(spark, sf_dir), m.FOCAL, "tax_rate")


def _priced_sweep(spark, sf_dir):
    return scenarios.rate_sweep(m.firms(spark, sf_dir)).withColumn(
        "optimal_price", markup_price() * (1 + F.col("FA_tax_rate") / F.col("epsilon"))
    )


@query
def sweep_distortion(spark, sf_dir):
    return apportionment.sweep_distortion(_priced_sweep(spark, sf_dir))


@query
def implied_price(spark, sf_dir):
    """Prices read off the demand curve at the solved quantities."""
    return m.solved_panel(spark, sf_dir).select(
        "firm_id", "state", "year",
        inverse_demand("optimal_quantity_consumed").alias("implied_price"),
    )


@query
def apportioned_profit(spark, sf_dir):
    return apportionment.apportioned_profit(m.factor_panel(spark, sf_dir))


@query
def apportioned_profit_trade(spark, sf_dir):
    return apportionment.apportioned_profit(
        m.factor_panel(spark, sf_dir), m.trade_flows(spark, sf_dir)
    )


@query
def evaluated_profit(spark, sf_dir):
    """Profit at given prices and factors, trade costs from their CSV file."""
    folder = _folder(spark, "trade-costs")
    flows = m.trade_flows(spark, sf_dir)
    costs = schemas.TRADE_COSTS.fieldNames()
    readers.write_panel(flows.select(costs), folder)
    keys = ("firm_id", "year", "producing_state", "consuming_state")
    return model.evaluated(m.factor_panel(spark, sf_dir), folder, flows.drop(*(c for c in costs if c not in keys)))


@query
def trade_margins(spark, sf_dir):
    return apportionment.trade_margins(m.trade_flows(spark, sf_dir))


@query
def state_ratios(spark, sf_dir):
    priced = _priced_sweep(spark, sf_dir).withColumnRenamed("optimal_price", "price")
    priced = priced.withColumn("quantity", demand("price")).withColumns({
        "labour": F.col("quantity") * (1 - F.col("FA_tax_rate")),
        "wage": F.pow(F.col("quantity"), F.lit(0.25)),
    })
    return apportionment.state_ratios(priced, ["price", "quantity", "labour", "wage"])


@query
def pricing_residual(spark, sf_dir):
    return apportionment.pricing_residual(m.factor_panel(spark, sf_dir)).select(
        "firm_id", "state", "year", "mean_rate", "excess_rate", "residual"
    )
