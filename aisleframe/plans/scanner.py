"""The scanner study from weekly files to regression tables.

Each step reads the tables of the steps before and writes its own, so a step can be run again alone.
All categories are one job; the category is a folder key, not a loop.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aisleframe.operators import collapse, exposure, pricing, regression, reshape, specs, taxes
from aisleframe.operators.joins import update_join
from aisleframe.plans.study import Study
from aisleframe.sources import readers, schemas
from aisleframe.sources.stages import StepLog, read_stage, stage_table, write_results, write_stage

QUARTERLY = "store_code_uc long, upc long, quarter int, revenue double, quantity double, " \
    "group string, year int"
PRODUCTS = "store_code_uc long, upc long, quarter int, revenue double, quantity double, " \
    "parent_code long, fips_state_code int, upc_ver_uc int, price double, group string, year int"
EXTRAS = "quarter int, fips_state_code int, parent_code long, store_code_uc long, " \
    "extras_group string, revenue double, quantity double, group string, year int"
STORE_GROUPS = "quarter int, fips_state_code int, parent_code long, store_code_uc long, " \
    "revenue double, quantity double, group string, year int"
UNIFORM = "parent_code long, extras_group string, quarter int, price_mean double, " \
    "price_sd double, total_revenue double, mode_share double, hhi double, coef_var double, " \
    "group string, year int"


@dataclass
class ScannerPlan:
    """One output folder with a table per step."""

    spark: SparkSession
    out: str
    study: Study = field(default_factory=Study)

    def path(self, step: str) -> str:
        return f"{self.out.rstrip('/')}/{step}"

    def clean(self, movement: str | Sequence[str]) -> None:
        """Weekly files to store x upc x quarter."""
        weeks = readers.read_movement(self.spark, movement)
        write_stage(collapse.movement_quarter(weeks), self.path("clean"))

    def products(self, stores: DataFrame, versions: DataFrame) -> None:
        """Attach parent, state, product version and price."""
        clean = read_stage(self.spark, self.path("clean"), QUARTERLY)
        write_stage(collapse.product_panel(clean, stores, versions), self.path("products"))

    def collapse(self, extras: DataFrame, attributes: Sequence[str] = schemas.ATTRIBUTES) -> None:
        """Store x extras group, store x product group, parent x state: each from the one before."""
        products = read_stage(self.spark, self.path("products"), PRODUCTS)
        write_stage(collapse.extras_collapse(products, extras, attributes), self.path("extras"))
        write_stage(collapse.store_group_collapse(self.extras()), self.path("store_groups"))
        self.collapse_parents()

    def collapse_parents(self) -> None:
        write_results(
            collapse.parent_state(read_stage(self.spark, self.path("store_groups"), STORE_GROUPS)),
            self.path("parents"),
        )

    def extras(self) -> DataFrame:
        return read_stage(self.spark, self.path("extras"), EXTRAS)

    def windowed(self, df: DataFrame) -> DataFrame:
        return df.where(F.col("year").between(*self.study.window))

    def uniform(self) -> None:
        """Price summaries per chain, product and quarter."""
        summaries = pricing.uniform_price(self.extras(), digits=self.study.price_digits)
        write_stage(summaries, self.path("uniform"))

    def bins(self, by: Sequence[str] = ("group",)) -> DataFrame:
        """Categories by price concentration."""
        uniform = self.windowed(read_stage(self.spark, self.path("uniform"), UNIFORM))
        return pricing.hhi_bins(uniform, by, self.study.bins)

    def flags(self) -> DataFrame:
        """Exposure of each parent-state row."""
        parents = self.windowed(self.spark.read.parquet(self.path("parents")))
        return exposure.exposure_flags(parents, self.study.focal, self.study.others)

    def panel(self, rates: DataFrame, items: bool = False) -> DataFrame:
        """Regression panel at category level, or at product level with items."""
        source = self.extras() if items else read_stage(
            self.spark, self.path("store_groups"), STORE_GROUPS
        )
        keys = ("store_code_uc", "group", "extras_group") if items else ("store_code_uc", "group")
        return exposure.exposure_panel(
            self.windowed(source), self.flags(),
            taxes.zero_tax_states(rates, self.study.zero_tax_year),
            self.study.base, self.study.cutoff, keys, ("store_code_uc", "group"),
        )

    def frequent_items(self, rates: DataFrame, category: str, min_rows: int) -> DataFrame:
        """Product panel of one category, only products with more than min_rows rows in all years."""
        rows = self.extras().where(F.col("group") == category)
        kept = stage_table(
            self.windowed(collapse.frequent_groups(rows, min_rows)), "frequent-items"
        )
        return exposure.exposure_panel(
            kept, self.flags(), taxes.zero_tax_states(rates, self.study.zero_tax_year),
            self.study.base, self.study.cutoff,
            ("store_code_uc", "extras_group"), ("store_code_uc",),
        )

    def regressions(self, rates: DataFrame) -> None:
        """By category, by bin, pooled, and by category at product level."""
        s = self.study
        kw = {"focal": s.focal, "presence": s.presence}
        panel = stage_table(self.panel(rates), "panel")
        by_category = specs.category_specs(s.cutoff, **kw)
        names = [spec.name for spec in by_category]

        by_group = regression.fe_did(panel, by_category, ["group"])
        write_results(reshape.results_wide(by_group, names), self.path("results_group"))

        binned = update_join(panel, self.bins(), ["group"], ["hhi_bin"], unique=True)
        bin_specs = specs.flag_specs(s.cutoff, ("group",), **kw)
        by_bin = regression.fe_did(binned, bin_specs, ["hhi_bin"])
        write_results(
            reshape.results_wide(by_bin, [spec.name for spec in bin_specs], ["hhi_bin"]),
            self.path("results_hhi"),
        )

        pooled = regression.fe_did(panel, specs.pooled_specs(s.cutoff, s.placebos, **kw))
        write_results(pooled, self.path("results_pooled"))

        by_item = regression.fe_did(
            self.panel(rates, items=True),
            specs.category_specs(s.cutoff, ("extras_group",), **kw), ["group"],
        )
        write_results(reshape.results_wide(by_item, names), self.path("results_extras"))

    def run(self, movement: str | Sequence[str], stores: DataFrame, versions: DataFrame,
            extras: DataFrame, rates: DataFrame,
            attributes: Sequence[str] = schemas.ATTRIBUTES, resume: bool = False) -> list[str]:
        """All steps; returns the names of those that ran. Only the results stay in the folder.

        With resume, steps that an earlier run with the same study, files and attributes has finished are
        not run again. Files are known by their paths; one that changed in place needs a fresh run.
        """
        weeks = readers.read_movement(self.spark, movement)
        inputs = [sorted(df.inputFiles()) for df in (weeks, stores, versions, extras, rates)]
        key = sha256(repr((self.study, inputs, list(attributes))).encode()).hexdigest()
        return StepLog(self.spark, self.path("steps"), key).run({
            "clean": lambda: self.clean(movement),
            "products": lambda: self.products(stores, versions),
            "collapse": lambda: self.collapse(extras, attributes),
            "uniform": self.uniform,
            "regressions": lambda: self.regressions(rates),
        }, resume)
