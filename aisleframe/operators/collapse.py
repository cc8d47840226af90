"""From weekly movement to quarterly store, product-group and chain panels.

Every step sums the one before over fewer keys, so totals agree along the chain
week -> upc -> extras group -> product group -> parent by state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisleframe.functions.groups import rows_in, share_of
from aisleframe.functions.scalars import quarter_of, unit_price, week_revenue, year_of
from aisleframe.operators.joins import one_row_per_key, update_join
from aisleframe.sources.stages import stage_table

EXTRAS_KEYS = (
    "year", "quarter", "fips_state_code", "parent_code", "store_code_uc", "group", "extras_group"
)
GROUP_KEYS = ("year", "quarter", "fips_state_code", "parent_code", "store_code_uc", "group")
PARENT_KEYS = ("year", "quarter", "fips_state_code", "parent_code")


def total_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Revenue and quantity summed by the keys."""
    return df.groupBy(*keys).agg(
        F.sum("revenue").alias("revenue"), F.sum("quantity").alias("quantity")
    )


def weekly_measures(movement: DataFrame) -> DataFrame:
    """Year, quarter, revenue and quantity of each weekly row.

    A year from the file name wins over the year of the week's last day.
    """
    return movement.select(
        *[c for c in ("store_code_uc", "upc", "group") if c in movement.columns],
        (F.col("year") if "year" in movement.columns else year_of("week_end")).alias("year"),
        quarter_of("week_end").alias("quarter"),
        week_revenue("price", "prmult", "units").alias("revenue"),
        F.col("units").alias("quantity"),
    )


def movement_quarter(movement: DataFrame, together: Sequence[str] = ()) -> DataFrame:
    """Weeks to store x upc x quarter, the category carried along when the movement has it.

    `together` names some of the keys by which later steps group: the weeks are dealt by them alone, so that
    one exchange serves all these steps, but are not summed before it.
    """
    weekly = weekly_measures(movement)
    if together:
        weekly = weekly.repartition(*together)
    group = ["group"] if "group" in weekly.columns else []
    return total_by(weekly, [*group, "store_code_uc", "upc", "year", "quarter"])


def movement_totals(movement: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weeks straight to coarser keys, for results that do not need the product level."""
    return total_by(weekly_measures(movement), keys)


def attach_stores(df: DataFrame, stores: DataFrame, unique: bool = False,
                  order: Sequence[str] = ()) -> DataFrame:
    """Parent and state of the store in that year; of several reports the last in the stated order."""
    columns = ["parent_code", "fips_state_code"]
    return update_join(df, stores, ["store_code_uc", "year"], columns, order, unique, period="year")


def attach_versions(df: DataFrame, versions: DataFrame, unique: bool = False,
                    order: Sequence[str] = ()) -> DataFrame:
    """Version of the product in that year; of several reports the last in the stated order."""
    return update_join(df, versions, ["upc", "year"], ["upc_ver_uc"], order, unique, period="year")


def product_panel(quarterly: DataFrame, stores: DataFrame, versions: DataFrame,
                  unique: bool = False, order: Sequence[str] = ()) -> DataFrame:
    """Store x upc x quarter with parent, state, product version and unit price.

    `unique` states that the dimension tables have one row per key; `order` names the columns of both
    by which the last of several rows is taken.
    """
    joined = attach_versions(attach_stores(quarterly, stores, unique, order), versions, unique, order)
    return joined.withColumn("price", unit_price())


def attribute_group(attributes: Sequence[str]) -> Column:
    """Identifier of a combination of attribute values; a missing value is a value of its own.

    The digest is a function of the row alone: no numbering pass, no sort of a whole category, the
    same identifier in every run. The JSON text keeps field names, so (NULL, a) and (a, NULL)
    differ.
    """
    return F.md5(F.to_json(F.struct(*attributes)))


def attach_extras_group(df: DataFrame, extras: DataFrame, attributes: Sequence[str],
                        unique: bool = False) -> DataFrame:
    """Extras group of the product in that year.

    The identifier is made on the attribute table, so the join moves its 16 bytes, as two numbers, instead of
    all attributes. Products without attributes fall into the group whose attributes are all missing.
    """
    keys = ["upc", "year"]
    once = extras if unique else one_row_per_key(extras, keys, attributes)
    digest = attribute_group(attributes)
    halves = {f"_half_{i}": F.conv(F.substring(digest, 1 + 16 * i, 16), 16, -10).cast("long") for i in (0, 1)}
    grouped = once.select(*keys, *[half.alias(name) for name, half in halves.items()])
    joined = update_join(df, grouped, keys, list(halves), unique=True, period="year")
    text = F.lower(F.concat(*[F.lpad(F.hex(name), 16, "0") for name in halves]))
    known = [F.col("extras_group")] if "extras_group" in df.columns else []
    return joined.withColumn("extras_group", F.coalesce(text, *known, F.md5(F.lit("{}")))).drop(*halves)


def extras_groups(extras: DataFrame, attributes: Sequence[str],
                  keys: Sequence[str] = ("group",)) -> DataFrame:
    """The distinct attribute combinations of each category and how many product-years they hold."""
    return extras.groupBy(*keys, *attributes).agg(F.count(F.lit(1)).alias("n_products")).withColumn(
        "extras_group", attribute_group(attributes)
    )


def extras_collapse(products: DataFrame, extras: DataFrame, attributes: Sequence[str],
                    unique: bool = False, together: Sequence[str] = ()) -> DataFrame:
    """Store x extras group x quarter, from any store x upc x quarter panel with parent and state.

    `together` names some of the keys by which a later step groups: the rows are dealt by them alone, so that
    one exchange serves the collapse and that step. Products of a store's group that already lie in the same
    task are then not summed before the exchange.
    """
    grouped = attach_extras_group(products, extras, attributes, unique)
    return total_by(grouped.repartition(*together) if together else grouped, EXTRAS_KEYS)


def store_group_collapse(df: DataFrame) -> DataFrame:
    """Store x product group x quarter."""
    return total_by(df, GROUP_KEYS)


def parent_state(df: DataFrame) -> DataFrame:
    """Parent x state x quarter with the share of the parent's sales made in each state and the
    number of states it is present in.

    Both windows share one exchange; a group holds at most one row per state.
    """
    chain = ["year", "quarter", "parent_code"]
    return total_by(df, PARENT_KEYS).select(
        "*",
        share_of("revenue", chain).alias("state_sales_share"),
        rows_in(chain).alias("presence_count"),
    )


def frequent_groups(df: DataFrame, min_rows: int,
                    keys: Sequence[str] = ("group", "extras_group")) -> DataFrame:
    """Keep the rows of groups with more than min_rows rows.

    Counted by aggregate; the kept groups, at most rows / min_rows of them, are written and joined
    back, so the rows themselves need not be shuffled. df is read twice.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = stage_table(counts.where(F.col("_n") > min_rows).select(*keys), "frequent-groups")
    return df.join(large, list(keys), "left_semi")
