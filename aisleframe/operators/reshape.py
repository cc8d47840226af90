"""Reshaping and relabelling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def results_wide(results: DataFrame, specs: Sequence[str], by: Sequence[str] = ("group",)) -> DataFrame:
    """Long regression results to one row per `by` with columns <spec>_b, _se, _n, _r2."""
    return results.groupBy(*by).pivot("spec", list(specs)).agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("b", "se", "n", "r2")]
    )


def regime_long(df: DataFrame, keys: Sequence[str], columns: Mapping[str, str],
                label: str = "regime", value: str = "price") -> DataFrame:
    """Wide prices (or quantities) by regime to one row per regime; columns maps label -> column."""
    renamed = df.select(*keys, *[F.col(c).alias(name) for name, c in columns.items()])
    return renamed.unpivot(list(keys), list(columns), label, value)


def relabel_union(df: DataFrame, condition: Column, changes: Mapping[str, Column]) -> DataFrame:
    """Append a relabelled copy of a subset of the rows."""
    return df.unionByName(df.where(condition).withColumns(dict(changes)))


def conditional_update(df: DataFrame, condition: Column, changes: Mapping[str, Column]) -> DataFrame:
    """Overwrite columns on the rows that fulfil the condition."""
    return df.withColumns({
        c: F.when(condition, value).otherwise(F.col(c) if c in df.columns else F.lit(None))
        for c, value in changes.items()
    })


def as_doubles(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Coerce every column to double, except those named."""
    return df.select([F.col(c) if c in keep else F.col(c).cast("double").alias(c) for c in df.columns])
