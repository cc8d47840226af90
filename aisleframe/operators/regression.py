"""Fixed-effects difference-in-differences with cluster-robust errors, by distributed aggregates.

y is regressed on x and post * x with one absorbed cell. post is constant inside a cell, because every
cell contains the quarter, so it is absorbed too and the reported coefficient is that of post * x.

All specifications that absorb the same cells run in one pass: their sums are conditional aggregates
over the same rows, so the panel is neither copied per specification nor scanned once for each. Two
passes over a narrow staged panel are needed: cell means, then cluster sums of demeaned products.
Cell means and coefficients are written before they are joined; known to be small they are broadcast
and the panel stays where it is, and when they are not, the merge join splits hot cells.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisleframe.functions.scalars import safe_div
from aisleframe.operators.joins import attach
from aisleframe.operators.specs import DidSpec
from aisleframe.sources.stages import stage_table

PRODUCTS = ("xx", "xz", "zz", "xy", "zy", "yy")


def demean(df: DataFrame, cols: Sequence[str], cell: Sequence[str]) -> DataFrame:
    """Absorb one fixed effect: subtract the cell mean from each column, as `<column>_d`."""
    means = attach(df, cell, {f"_mean_{c}": F.avg(c) for c in cols})
    return means.select(
        *df.columns, *[(F.col(c) - F.col(f"_mean_{c}")).alias(f"{c}_d") for c in cols]
    )


def fe_did(panel: DataFrame, specs: Sequence[DidSpec], by: Sequence[str] = (),
           y: str = "dlprice_pre", cluster: str = "store_code_uc", year: str = "year") -> DataFrame:
    """Coefficient of post * x, its clustered error, N and within adjusted R2, one row per
    combination of `by` and specification; NULL where the regression cannot be fitted.
    """
    by = list(by)
    cells = list(dict.fromkeys(spec.fe for spec in specs))
    keys = list(dict.fromkeys([*by, *[k for fe in cells for k in fe], cluster]))
    narrow = stage_table(
        panel.select(
            *keys,
            F.col(year).alias("_year"),
            F.col(y).cast("double").alias("_y"),
            *[_treatment(s, [*by, *s.fe, cluster], y) for s in specs],
        ),
        "did-panel",
    )
    sums = [_sums(narrow, [s for s in specs if s.fe == fe], fe, by, cluster) for fe in cells]
    sizes = reduce(DataFrame.unionByName, [size for size, _ in sums])
    clusters = reduce(DataFrame.unionByName, [cluster_sums for _, cluster_sums in sums])
    return _estimates(_runs(narrow, specs, by), sizes, clusters, by)


def _runs(narrow: DataFrame, specs: Sequence[DidSpec], by: list[str]) -> DataFrame:
    """Every combination of `by` and specification, also those without a usable row."""
    names = F.explode(F.array(*[F.lit(s.name) for s in specs])).alias("spec")
    runs = narrow.select(*by).distinct().dropna() if by else narrow.sparkSession.range(1)
    return runs.select(*by, names)


def _treatment(spec: DidSpec, keys: Sequence[str], y: str) -> Column:
    """x on the rows the regression uses, NULL elsewhere: outside the sample or with a gap."""
    complete = " AND ".join(f"`{k}` IS NOT NULL" for k in [*keys, y])
    return F.expr(
        f"CASE WHEN ({spec.sample}) AND {complete} THEN CAST(({spec.x}) AS DOUBLE) END"
    ).alias(f"x_{spec.name}")


def _stack(df: DataFrame, keys: Sequence[str], specs: Sequence[DidSpec],
           fields: Sequence[str]) -> DataFrame:
    """Columns <field>_<spec> to one row per specification."""
    rows = ", ".join(
        f"named_struct('spec', '{s.name}', " + ", ".join(f"'{f}', {f}_{s.name}" for f in fields) + ")"
        for s in specs
    )
    return df.select(*keys, F.expr(f"inline(array({rows}))"))


def _sums(narrow: DataFrame, specs: Sequence[DidSpec], fe: Sequence[str], by: list[str],
          cluster: str) -> tuple[DataFrame, DataFrame]:
    """Sizes by run, and sums of demeaned products by run and cluster, of the specifications that
    absorb the same cells.
    """
    cell = list(dict.fromkeys([*by, *fe]))
    means, products = [], []
    for s in specs:
        x, n = f"x_{s.name}", s.name
        z = f"{x} * int(_year >= {s.cutoff})"
        xd, zd = f"({x} - mx_{n})", f"({z} - mz_{n})"
        yd = f"if({x} IS NULL, NULL, _y - my_{n})"
        means += [
            f"count({x}) AS n_{n}", f"avg(if({x} IS NULL, NULL, _y)) AS my_{n}",
            f"avg({x}) AS mx_{n}", f"avg({z}) AS mz_{n}",
        ]
        products += [
            f"count({x}) AS n_{n}",
            f"sum({xd} * {xd}) AS xx_{n}", f"sum({xd} * {zd}) AS xz_{n}",
            f"sum({zd} * {zd}) AS zz_{n}", f"sum({xd} * {yd}) AS xy_{n}",
            f"sum({zd} * {yd}) AS zy_{n}", f"sum({yd} * {yd}) AS yy_{n}",
        ]

    used = narrow.where(" OR ".join(f"x_{s.name} IS NOT NULL" for s in specs))
    cells = stage_table(used.groupBy(*cell).agg(*map(F.expr, means)), "did-cells")
    sizes = _stack(cells, by, specs, ["n", "mx", "mz"]).where("n > 0").groupBy(*by, "spec").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("cells"),
        F.expr("sum(n * mx * mx)").alias("x_between"),
        F.expr("sum(n * mz * mz)").alias("z_between"),
    )
    wide = used.join(cells, cell).groupBy(*by, cluster).agg(*map(F.expr, products))
    clusters = stage_table(
        _stack(wide, [*by, cluster], specs, ["n", *PRODUCTS]).where("n > 0").drop("n"),
        "did-clusters",
    )
    return sizes, clusters


def _estimates(runs: DataFrame, sizes: DataFrame, clusters: DataFrame, by: list[str]) -> DataFrame:
    """Coefficients from the summed products, then their clustered errors from cluster scores."""
    run = [*by, "spec"]
    moments = clusters.groupBy(*run).agg(
        *[F.sum(c).alias(c) for c in PRODUCTS], F.count(F.lit(1)).alias("g")
    )
    fitted = stage_table(
        _coefficients(runs.join(sizes, run, "left").join(moments, run, "left")), "did-fit"
    )
    slopes = fitted.where("ok").select(*run, "b1", "b2")
    scored = clusters.join(slopes, run).select(
        *run,
        F.expr("xy - b1 * xx - b2 * xz").alias("s1"),
        F.expr("zy - b1 * xz - b2 * zz").alias("s2"),
    ).groupBy(*run).agg(
        F.expr("sum(s1 * s1)").alias("m11"),
        F.expr("sum(s1 * s2)").alias("m12"),
        F.expr("sum(s2 * s2)").alias("m22"),
    )
    return _results(fitted.join(scored, run, "left"), by)


def _coefficients(df: DataFrame) -> DataFrame:
    """Normal equations of the two demeaned regressors, and whether they can be solved.

    Centred sums of a regressor that is constant in every cell are rounding noise, hence the test
    against its raw sum of squares and not on the determinant alone.
    """
    xx, xz, zz, xy, zy = (F.col(c) for c in ("xx", "xz", "zz", "xy", "zy"))
    det = xx * zz - xz * xz
    solvable = (
        (F.col("n") - F.col("cells") - 2 > 0)
        & (F.col("g") >= 2)
        & (xx > 1e-12 * (xx + F.col("x_between")))
        & (zz > 1e-12 * (zz + F.col("z_between")))
        & (det > 1e-9 * xx * zz)
    )
    return df.withColumn("ok", F.coalesce(solvable, F.lit(False))).withColumn(
        "det", F.when(F.col("ok"), det)
    ).withColumns({
        "b1": (zz * xy - xz * zy) / F.col("det"),
        "b2": (xx * zy - xz * xy) / F.col("det"),
    })


def _results(df: DataFrame, by: Sequence[str]) -> DataFrame:
    n, cells, g = F.col("n"), F.col("cells"), F.col("g")
    xx, xz = F.col("xx"), F.col("xz")
    meat = xz * xz * F.col("m11") - 2 * xx * xz * F.col("m12") + xx * xx * F.col("m22")
    small_sample = safe_div(n - 1, n - 2 - cells) * safe_div(g, g - 1)
    residual = F.col("yy") - F.col("b1") * F.col("xy") - F.col("b2") * F.col("zy")
    freedom = safe_div(n - cells, n - cells - 2)
    return df.select(
        *by,
        "spec",
        F.when(F.col("ok"), F.col("b2")).alias("b"),
        F.when(F.col("ok"), F.sqrt(meat * small_sample) / F.col("det")).alias("se"),
        F.when(F.col("ok"), n).alias("n"),
        F.when(F.col("ok"), 1 - safe_div(residual, "yy") * freedom).alias("r2"),
    )
