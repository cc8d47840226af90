"""SQL counterparts of the queries, written independently of the operators."""

from __future__ import annotations

import re
from collections.abc import Sequence

from catalog.digits import EDGE, digits_of
from catalog.doubles import DOUBLES

FOCAL, CUTOFF = 6, 1998
YEARS = "generate_series(1995, 2001)"

PARENT = (
    "CASE s_suppkey % 3 WHEN 0 THEN s_suppkey WHEN 1 THEN 100000 + s_suppkey // 9 "
    "ELSE 200000 + s_suppkey // 30 END"
)

CTE: dict[str, str] = {
    "stores": f"""
        SELECT s_suppkey AS store_code_uc, CAST(y AS INTEGER) AS year, {PARENT} AS parent_code,
               s_nationkey AS fips_state_code
        FROM supplier, (SELECT unnest({YEARS}) AS y)""",
    "moves": """
        SELECT l_suppkey AS store_code_uc, l_partkey AS upc, p_type AS "group",
               CAST(year(l_shipdate) AS INTEGER) AS year,
               CAST(quarter(l_shipdate) AS INTEGER) AS quarter,
               l_extendedprice / nullif(l_linenumber, 0) * l_quantity AS revenue,
               l_quantity AS quantity
        FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""",
    "products": """
        SELECT m.*, s.parent_code, s.fips_state_code
        FROM (SELECT "group", store_code_uc, upc, year, quarter, sum(revenue) AS revenue,
                     sum(quantity) AS quantity
              FROM moves GROUP BY ALL) m
        LEFT JOIN stores s USING (store_code_uc, year)""",
    "attrs": """
        SELECT p_partkey AS upc, p_type AS "group", p_brand AS flavor_code,
               CASE WHEN p_size % 10 <> 0 THEN p_size // 10 END AS size_code
        FROM part""",
    "ids": """
        SELECT upc, md5('{' || concat_ws(',', '"flavor_code":"' || flavor_code || '"',
                                         '"size_code":' || size_code) || '}') AS extras_group
        FROM attrs""",
    "items": """
        SELECT year, quarter, fips_state_code, parent_code, store_code_uc, "group", extras_group,
               sum(revenue) AS revenue, sum(quantity) AS quantity
        FROM products LEFT JOIN ids USING (upc) GROUP BY ALL""",
    "sg": """
        SELECT year, quarter, fips_state_code, parent_code, store_code_uc, "group",
               sum(revenue) AS revenue, sum(quantity) AS quantity
        FROM products GROUP BY ALL""",
    "parents": """
        SELECT *, revenue / sum(revenue) OVER (PARTITION BY year, quarter, parent_code)
                    AS state_sales_share,
               count(*) OVER (PARTITION BY year, quarter, parent_code) AS presence_count
        FROM (SELECT year, quarter, fips_state_code, parent_code, sum(revenue) AS revenue,
                     sum(quantity) AS quantity
              FROM products GROUP BY ALL)""",
    "flags": f"""
        SELECT p.*, f.in_focal, f.in_state_12, f.in_state_18, f.in_state_23, f.in_state_11,
               CAST(f.in_focal = 1 AND p.presence_count = 1 AS INTEGER) AS only_in_focal,
               CAST(p.fips_state_code = f.first_state AS INTEGER) AS parent_flag,
               coalesce(f.focal_share, 0) AS focal_share, f.total_revenue
        FROM parents p JOIN (
            SELECT year, quarter, parent_code,
                   max(CAST(fips_state_code = {FOCAL} AS INTEGER)) AS in_focal,
                   max(CAST(fips_state_code = 12 AS INTEGER)) AS in_state_12,
                   max(CAST(fips_state_code = 18 AS INTEGER)) AS in_state_18,
                   max(CAST(fips_state_code = 23 AS INTEGER)) AS in_state_23,
                   max(CAST(fips_state_code = 11 AS INTEGER)) AS in_state_11,
                   min(fips_state_code) AS first_state,
                   max(state_sales_share) FILTER (fips_state_code = {FOCAL}) AS focal_share,
                   sum(revenue) AS total_revenue
            FROM parents GROUP BY ALL) f USING (year, quarter, parent_code)""",
    "rates": """
        SELECT n_nationkey AS statefips, CAST(y AS INTEGER) AS year,
               ((n_nationkey * 7) % 5) / 50.0::DOUBLE
                 + CASE WHEN n_nationkey % 4 = 2 AND y >= 1998 THEN 0.02::DOUBLE ELSE 0 END AS t_corp,
               (50 + 10 * (n_nationkey % 4)
                 + CASE WHEN n_nationkey % 4 = 1 AND y >= 1998 THEN 10 ELSE 0 END)::DOUBLE
                 AS wgt_sales
        FROM nation, (SELECT unnest(generate_series(1993, 2001)) AS y)""",
    "taxes": """
        SELECT r.statefips, r.year, r.t_corp, r.wgt_sales, p.t_x
        FROM rates r LEFT JOIN (
            SELECT s_nationkey AS statefips, year(l_shipdate) AS year,
                   100 * sum(l_tax * l_extendedprice) / sum(l_extendedprice) AS t_x
            FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL) p
        USING (statefips, year)""",
    "dtaxes": """
        SELECT *, round(t_x - lag(t_x) OVER w, 2) AS dt_x,
               round(t_corp - lag(t_corp) OVER w, 2) AS dt_corp,
               round(wgt_sales - lag(wgt_sales) OVER w, 2) AS dwgt_sales
        FROM taxes WINDOW w AS (PARTITION BY statefips ORDER BY year)""",
    "unif": """
        WITH points AS (
            SELECT parent_code, "group", extras_group, year, quarter,
                   round(revenue / nullif(quantity, 0), -2) AS price, count(*) AS n,
                   sum(revenue) AS revenue, sum(quantity) AS w
            FROM items GROUP BY ALL),
        means AS (
            SELECT parent_code, "group", extras_group, year, quarter,
                   sum(price * w) / sum(w) AS mean, max(n) AS top, sum(n) AS total
            FROM points GROUP BY ALL)
        SELECT parent_code, "group", extras_group, year, quarter, max(mean) AS price_mean,
               CASE WHEN sum(w) > 1
                    THEN sqrt(sum(w * (price - mean) * (price - mean)) / (sum(w) - 1)) END
                 AS price_sd,
               sum(revenue) AS total_revenue,
               sum(CASE WHEN n = top THEN n ELSE 0 END) / sum(n) AS mode_share,
               sum((n / total) * (n / total)) AS hhi,
               price_sd / nullif(price_mean, 0) AS coef_var
        FROM points JOIN means USING (parent_code, "group", extras_group, year, quarter)
        GROUP BY ALL""",
    "conc": """
        SELECT "group", avg(hhi) AS hhi
        FROM (SELECT "group", year, quarter, sum(hhi * total_revenue) / sum(total_revenue) AS hhi
              FROM unif WHERE year BETWEEN 1996 AND 2000 GROUP BY ALL) GROUP BY ALL""",
    "conc_items": """
        SELECT "group", extras_group, avg(hhi) AS hhi
        FROM (SELECT "group", extras_group, year, quarter,
                     sum(hhi * total_revenue) / sum(total_revenue) AS hhi
              FROM unif WHERE year BETWEEN 1996 AND 2000 GROUP BY ALL) GROUP BY ALL""",
    "bins": """
        SELECT "group", hhi, CAST(1 + (hhi > c[2])::INT + (hhi > c[3])::INT + (hhi > c[4])::INT
                                    + (hhi > c[5])::INT AS INTEGER) AS hhi_bin
        FROM conc, (SELECT quantile_cont(hhi, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS c FROM conc)""",
    "zero": "SELECT statefips AS fips_state_code, t_corp = 0 AS zerotax FROM rates WHERE year = 1998",
}


def _exposure(source: str, series: str, extra: str = "") -> str:
    """Panel of the study window; flags are recomputed on it, as quarters do not interact."""
    return f"""
        SELECT *, avg(CASE WHEN year < {CUTOFF} THEN focal_share END)
                    OVER (PARTITION BY store_code_uc, "group") AS focal_share_pre
        FROM (
            SELECT s.*, f.state_sales_share, f.presence_count, f.in_focal, f.only_in_focal,
                   f.focal_share, {extra} f.revenue AS gross_revenue, z.zerotax,
                   s.year * 4 + s.quarter - 1 AS yearqtr,
                   s.revenue / nullif(s.quantity, 0) AS price,
                   ln(nullif(s.revenue / nullif(s.quantity, 0), 0)) AS lprice,
                   lprice - max(CASE WHEN s.year = 1997 AND s.quarter = 4
                                     THEN ln(nullif(s.revenue / nullif(s.quantity, 0), 0)) END)
                              OVER (PARTITION BY {series}) AS dlprice_pre
            FROM (SELECT * FROM {source} WHERE year BETWEEN 1996 AND 2000) s
            LEFT JOIN flags f USING (year, quarter, parent_code, fips_state_code)
            LEFT JOIN zero z USING (fips_state_code))"""


CTE["panel"] = _exposure("sg", 's.store_code_uc, s."group"')
CTE["panel12"] = _exposure("sg", 's.store_code_uc, s."group"', "f.in_state_12,")
CTE["panel_items"] = _exposure("items", 's.store_code_uc, s."group", s.extras_group')

CTE |= {
    "chain": """
        SELECT parent_code AS firm_id, fips_state_code AS state, year, sum(revenue) AS revenue
        FROM products GROUP BY ALL""",
    "firms": """
        SELECT firm_id, 4.1::DOUBLE + firm_id % 3 AS epsilon, sum(revenue) / 1000000 AS kappa,
               1::DOUBLE AS cost
        FROM chain GROUP BY firm_id""",
    "firm_panel": """
        SELECT firm_id, state, c.year, revenue, 4.1::DOUBLE + state % 3 AS epsilon,
               1::DOUBLE AS cost, t_corp AS tax_rate
        FROM chain c JOIN rates r ON c.state = r.statefips AND c.year = r.year""",
    "calibrated": """
        SELECT *, epsilon / (epsilon - 1) * cost AS price, revenue / price AS quantity,
               quantity / pow(price, -epsilon) AS kappa
        FROM firm_panel""",
    "solved": """
        SELECT *, optimal_quantity_consumed * (1 + 0.02::DOUBLE * (state % 3))
                 AS optimal_quantity_produced,
               optimal_price * optimal_quantity_consumed AS optimal_state_revenue,
               cost * (1 + 0.05::DOUBLE * (state % 4)) * optimal_quantity_produced
                 AS optimal_state_cost
        FROM (SELECT firm_id, state, year, epsilon, cost, tax_rate, kappa,
                     epsilon / (epsilon - 1) * cost * (1 + 0.8::DOUBLE * tax_rate / epsilon)
                       AS optimal_price,
                     kappa * pow(optimal_price, -epsilon)
                       * (0.95::DOUBLE + 0.01::DOUBLE * (state % 5)) AS optimal_quantity_consumed
              FROM calibrated)""",
    "cf_base": """
        SELECT *, epsilon / (epsilon - 1) * cost AS naive_price,
               epsilon / (epsilon - 1) * cost * (1 + tax_rate / epsilon)
                 AS perceived_sales_tax_price,
               kappa * pow(naive_price, -epsilon) AS naive_quantity,
               kappa * pow(perceived_sales_tax_price, -epsilon) AS perceived_sales_tax_quantity,
               optimal_quantity_consumed AS optimal_quantity,
               naive_price * naive_quantity AS naive_revenue,
               perceived_sales_tax_price * perceived_sales_tax_quantity
                 AS perceived_sales_tax_revenue,
               optimal_state_revenue AS optimal_revenue,
               naive_quantity * (naive_price - cost) AS naive_state_profits,
               perceived_sales_tax_quantity * (perceived_sales_tax_price - cost)
                 AS perceived_sales_tax_state_profits,
               optimal_quantity * (optimal_price - cost) AS optimal_state_profits,
               naive_price AS sales_tax_producer_price,
               naive_price * (1 + tax_rate / epsilon) AS sales_tax_consumer_price,
               kappa * pow(sales_tax_consumer_price, -epsilon) AS sales_tax_quantity,
               sales_tax_quantity * (sales_tax_producer_price - cost) AS sales_tax_profits
        FROM solved""",
    "cf": "SELECT *, " + ", ".join(
        f"{r}_revenue / sum({r}_revenue) OVER y AS {r}_sales_share, "
        f"{r}_revenue / sum({r}_revenue) OVER y * tax_rate * sum({r}_state_profits) OVER y "
        f"AS {r}_state_tax_bill"
        for r in ("perceived_sales_tax", "naive", "optimal")
    ) + " FROM cf_base WINDOW y AS (PARTITION BY year)",
    "factors": """
        SELECT firm_id, state, year, epsilon, kappa, cost, tax_rate AS FA_tax_rate,
               optimal_price AS p, optimal_quantity_consumed AS q, q * 0.6::DOUBLE AS l,
               q * 0.4::DOUBLE AS k, q * 0.1::DOUBLE AS m,
               CASE WHEN state % 2 = 0 THEN 0.5::DOUBLE
                    ELSE pow(q * 0.6::DOUBLE / 24.5::DOUBLE, 1 / 3.8::DOUBLE) END AS w,
               w * l AS payroll, 0.4::DOUBLE * k AS property, p * q AS sales,
               pow(k, 0.3::DOUBLE) * pow(l, 1 - 0.3::DOUBLE) + m AS output,
               payroll + property + cost * m AS factor_cost
        FROM solved""",
    "shares": """
        SELECT *, FA_tax_rate * (0.5::DOUBLE * sales / sum(sales) OVER f
                                 + 0.25::DOUBLE * payroll / sum(payroll) OVER f
                                 + 0.25::DOUBLE * property / sum(property) OVER f) AS rate
        FROM factors WINDOW f AS (PARTITION BY firm_id, year)""",
    "flows": f"""
        SELECT {PARENT} AS firm_id, CAST(year(l_shipdate) AS INTEGER) AS year,
               s_nationkey AS producing_state, c_nationkey AS consuming_state,
               sum(l_quantity) AS quantity,
               CASE WHEN s_nationkey = c_nationkey THEN 0::DOUBLE ELSE 0.05::DOUBLE END AS iceberg,
               CASE WHEN s_nationkey = c_nationkey THEN 0::DOUBLE ELSE 0.01::DOUBLE END AS unit_cost
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
             JOIN supplier ON l_suppkey = s_suppkey
        GROUP BY ALL""",
    "sweep": """
        SELECT firm_id, epsilon, kappa, cost, CAST(s AS INTEGER) AS state,
               CAST(j * 20 + i + 1 AS INTEGER) AS year,
               0.6::DOUBLE * (CASE s WHEN 1 THEN i ELSE j END) / 19 AS FA_tax_rate
        FROM firms, (SELECT unnest(generate_series(0, 19)) AS i),
             (SELECT unnest(generate_series(0, 19)) AS j),
             (SELECT unnest([1, 2]) AS s)""",
}

ORDER = list(CTE)


def _needs(sql: str) -> list[str]:
    """CTEs a statement names, with those they name themselves, in definition order."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name in words & set(CTE) - found:
            found.add(name)
            todo.append(CTE[name])
    return [name for name in ORDER if name in found]


# --- regressions -------------------------------------------------------------------------------

AWAY = f"fips_state_code <> {FOCAL}"
HERE = f"fips_state_code = {FOCAL}"
FEW = "presence_count BETWEEN 2 AND 5"
MULTI = "in_focal = 1 AND only_in_focal = 0"
STATE = f"CAST({HERE} AS INTEGER)"
SHARE = "focal_share_pre"

FLAG_SPECS = {
    "r1": (HERE, "only_in_focal", False),
    "r2": (AWAY, "in_focal", False),
    "r3": (f"{AWAY} AND zerotax", "in_focal", False),
    "r4": (f"{AWAY} AND {FEW}", "in_focal", False),
    "r5": (f"{AWAY} AND zerotax AND {FEW}", "in_focal", False),
    "r6": (MULTI, STATE, True),
    "r7": (f"{MULTI} AND presence_count <= 5", STATE, True),
}
CATEGORY_SPECS = FLAG_SPECS | {
    "r2a": (AWAY, SHARE, False),
    "r3a": (f"{AWAY} AND zerotax", SHARE, False),
    "r4a": (f"{AWAY} AND {FEW}", SHARE, False),
}
POOLED_SPECS = FLAG_SPECS | {
    "r8": (AWAY, SHARE, False),
    "r9": (f"{AWAY} AND zerotax", SHARE, False),
    "r10": (f"{AWAY} AND {FEW}", SHARE, False),
    "r11": (f"{AWAY} AND zerotax AND {FEW}", SHARE, False),
    "r12": (f"{AWAY} AND zerotax AND {FEW}", SHARE, False),
    "r13": (f"{AWAY} AND zerotax AND {FEW}", SHARE, False),
}
CUTOFFS = {"r12": CUTOFF - 1, "r13": CUTOFF + 2}


def _fit(source: str, spec: str, sample: str, x: str, fe: str, by: str) -> str:
    """Closed-form least squares of one specification, centred by window means."""
    cutoff = CUTOFFS.get(spec, CUTOFF)
    cell = f"{by}, {fe}"
    return f"""
        WITH rows AS (
            SELECT {by} AS run, {fe}, store_code_uc AS g, dlprice_pre AS y,
                   CAST({x} AS DOUBLE) AS x, CAST({x} AS DOUBLE) * (year >= {cutoff})::INT AS z
            FROM {source} WHERE {sample} AND dlprice_pre IS NOT NULL AND {x} IS NOT NULL),
        centred AS (
            SELECT run, g, y - avg(y) OVER c AS y, x - avg(x) OVER c AS x, z - avg(z) OVER c AS z,
                   x AS x0, z AS z0, dense_rank() OVER (PARTITION BY run ORDER BY {fe}) AS cell
            FROM rows WINDOW c AS (PARTITION BY run, {fe})),
        sums AS (
            SELECT run, sum(x * x) AS a, sum(x * z) AS b, sum(z * z) AS c, sum(x * y) AS u,
                   sum(z * y) AS v, sum(y * y) AS yy, count(*) AS n, max(cell) AS cells,
                   count(DISTINCT g) AS g, sum(x0 * x0) AS xx0, sum(z0 * z0) AS zz0
            FROM centred GROUP BY run),
        fit AS (
            SELECT *, a * c - b * b AS d, (c * u - b * v) / nullif(d, 0) AS b1,
                   (a * v - b * u) / nullif(d, 0) AS b2,
                   n - cells - 2 > 0 AND g >= 2 AND a > 1e-12 * xx0 AND c > 1e-12 * zz0
                     AND d > 1e-9 * a * c AS ok
            FROM sums),
        scores AS (
            SELECT run, k.g, sum(x * (y - b1 * x - b2 * z)) AS s1,
                   sum(z * (y - b1 * x - b2 * z)) AS s2
            FROM centred k JOIN fit USING (run) GROUP BY run, k.g),
        meat AS (
            SELECT run, sum(s1 * s1) AS m11, sum(s1 * s2) AS m12, sum(s2 * s2) AS m22
            FROM scores GROUP BY run),
        runs AS (SELECT DISTINCT {by} AS run FROM {source} WHERE {by} IS NOT NULL)
        SELECT run, '{spec}' AS spec, CASE WHEN ok THEN b2 END AS b,
               CASE WHEN ok THEN sqrt((b * b * m11 - 2 * a * b * m12 + a * a * m22)
                    * (n - 1) / nullif(n - 2 - cells, 0) * g / nullif(g - 1, 0)) / d END AS se,
               CASE WHEN ok THEN n END AS n,
               CASE WHEN ok THEN 1 - (yy - b1 * u - b2 * v) / yy * (n - cells)
                    / nullif(n - cells - 2, 0) END AS r2
        FROM runs LEFT JOIN (SELECT fit.* RENAME (b AS b_), m11, m12, m22
                             FROM fit JOIN meat USING (run)) f USING (run)""".replace(
        "sqrt((b * b * m11 - 2 * a * b * m12", "sqrt((b_ * b_ * m11 - 2 * a * b_ * m12"
    )


def _did(specs: dict, source: str, by: str | None, item: str, chain_item: str | None = None) -> str:
    parts = []
    for name, (sample, x, chain) in specs.items():
        fe = f"{item}yearqtr"
        if chain:
            fe = f"{chain_item if chain_item is not None else 'parent_code, ' + item}yearqtr"
        fitted = _fit(source, name, sample, x, fe, by or "0")
        keep = f"run AS {by}, * EXCLUDE (run)" if by else "* EXCLUDE (run)"
        parts.append(f"SELECT {keep} FROM ({fitted})")
    return " UNION ALL ".join(parts)


SQL: dict[str, str] = {
    "stores_dim": "SELECT * FROM stores",
    "upc_versions": f"""
        SELECT p_partkey AS upc, 1 + p_size % 3 AS upc_ver_uc, CAST(y AS INTEGER) AS year
        FROM part, (SELECT unnest({YEARS}) AS y)""",
    "categories": "SELECT DISTINCT \"group\" FROM moves",
    "movement_quarter": """
        SELECT store_code_uc, upc, year, quarter, sum(revenue) AS revenue, sum(quantity) AS quantity
        FROM moves GROUP BY ALL""",
    "product_panel": """
        SELECT p.*, 1 + p_size % 3 AS upc_ver_uc, revenue / nullif(quantity, 0) AS price
        FROM products p LEFT JOIN part ON upc = p_partkey""",
    "extras_groups": """
        SELECT "group", flavor_code, size_code, 7 * count(*) AS n_products, extras_group
        FROM attrs JOIN ids USING (upc) GROUP BY ALL""",
    "extras_collapse": "SELECT * FROM items",
    "store_group_collapse": "SELECT * FROM sg",
    "parent_state": "SELECT * FROM parents",
    "frequent_groups": """
        SELECT * FROM (SELECT * FROM items QUALIFY count(*) OVER (PARTITION BY "group", extras_group) > 60)
        WHERE year BETWEEN 1996 AND 2000""",
    "uniform_price": "SELECT * FROM unif",
    "price_concentration": "SELECT * FROM conc",
    "hhi_bins": "SELECT * FROM bins",
    "hhi_bins_extras": """
        SELECT k.*, CAST(1 + (hhi > c[2])::INT + (hhi > c[3])::INT + (hhi > c[4])::INT
                           + (hhi > c[5])::INT AS INTEGER) AS hhi_bin
        FROM conc_items k, (SELECT quantile_cont(hhi, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS c FROM conc_items)""",
    "hhi_bin_panel": """
        SELECT sg.*, hhi_bin FROM sg LEFT JOIN bins USING ("group") WHERE year BETWEEN 1996 AND 2000""",
    "tax_changes": """
        SELECT *, abs(dt_x) AS mag FROM dtaxes WHERE year >= 1996 AND abs(dt_x) > 0""",
    "sales_weight_changes": "SELECT * FROM dtaxes WHERE dwgt_sales >= 10 AND year >= 1996",
    "exposure_flags": "SELECT * FROM flags",
    "exposure_panel": "SELECT * FROM panel",
    "exposure_panel_extras": "SELECT * FROM panel_items",
    "baseline_log_change": """
        SELECT year, quarter, fips_state_code, parent_code, store_code_uc, "group", revenue, quantity,
               yearqtr, price, lprice, dlprice_pre FROM panel""",
    "parent_summary": f"""
        SELECT year, quarter, count(*) AS n_parent_states, sum(parent_flag)::BIGINT AS n_parents,
               count(*) FILTER ({HERE}) AS n_in_focal,
               count(*) FILTER (only_in_focal = 1) AS n_only_in_focal,
               sum(revenue) FILTER (in_focal = 1) / sum(revenue) AS exposed_revenue_share,
               sum(revenue) FILTER ({HERE}) / sum(revenue) AS focal_revenue_share,
               avg(presence_count) FILTER ({MULTI} AND parent_flag = 1) AS mean_presence,
               avg(state_sales_share) FILTER ({HERE} AND only_in_focal = 0) AS mean_focal_share
        FROM flags GROUP BY ALL""",
    "focal_spillover": f"""
        SELECT *, tot_sales / sum(tot_sales) OVER (PARTITION BY year, quarter) AS sales_share
        FROM (SELECT year, quarter, fips_state_code, sum(revenue) AS tot_sales
              FROM flags WHERE in_focal = 1 AND {AWAY} GROUP BY ALL)""",
    "focal_sales_mix": f"""
        SELECT t.statefips AS fips_state_code, mean_sales, t_corp, t_x
        FROM (SELECT fips_state_code, share / sum(share) OVER () AS mean_sales
              FROM (SELECT fips_state_code,
                           sum(state_sales_share * total_revenue) / sum(total_revenue) AS share
                    FROM flags WHERE {MULTI} AND year = 1997 AND quarter = 4 GROUP BY ALL)) x
        RIGHT JOIN (SELECT * FROM taxes WHERE year = 1997) t ON x.fips_state_code = t.statefips""",
    "one_way_table": f"""
        SELECT *, n / sum(n) OVER (PARTITION BY "group", year, quarter) AS share
        FROM (SELECT "group", year, quarter, only_in_focal, count(*) AS n FROM panel WHERE {HERE}
              GROUP BY ALL)""",
    "two_way_table": """
        SELECT "group", year, quarter, in_focal, in_state_12, count(*) AS n
        FROM (SELECT * FROM panel12 QUALIFY store_code_uc = min(store_code_uc) OVER
                (PARTITION BY "group", year, quarter, parent_code)) GROUP BY ALL""",
    "distinct_counts": f"""
        SELECT "group", count(DISTINCT store_code_uc) FILTER ({HERE}) AS stores,
               count(DISTINCT store_code_uc) FILTER ({HERE} AND only_in_focal = 1) AS stores_only,
               count(DISTINCT store_code_uc) FILTER ({HERE} AND only_in_focal = 0)
                 AS stores_not_only,
               count(DISTINCT parent_code) FILTER ({HERE}) AS parents,
               count(DISTINCT parent_code) FILTER ({HERE} AND only_in_focal = 1) AS parents_only,
               count(DISTINCT parent_code) FILTER ({HERE} AND only_in_focal = 0)
                 AS parents_not_only,
               count(DISTINCT parent_code) FILTER (fips_state_code = 12) AS parents_there,
               count(DISTINCT parent_code) FILTER (fips_state_code = 12 AND in_focal = 1)
                 AS parents_there_exposed
        FROM panel GROUP BY ALL""",
    "filtered_means": f"""
        SELECT "group", avg(price) FILTER (year = 1997 AND {HERE} AND only_in_focal = 1) AS price_only,
               avg(price) FILTER (year = 1997 AND {HERE} AND only_in_focal = 0) AS price_not_only,
               avg(gross_revenue) FILTER (tag AND {HERE} AND only_in_focal = 1) AS revenue_only,
               avg(gross_revenue) FILTER (tag AND {HERE} AND only_in_focal = 0)
                 AS revenue_not_only,
               avg(gross_revenue) FILTER (tag AND fips_state_code = 12 AND in_focal = 1)
                 AS revenue_there_exposed,
               avg(gross_revenue) FILTER (tag AND fips_state_code = 12 AND in_focal = 0)
                 AS revenue_there_other
        FROM (SELECT *, year = 1997 AND quarter = 4 AND store_code_uc = min(store_code_uc) OVER
                (PARTITION BY "group", year, quarter, parent_code) AS tag FROM panel) GROUP BY ALL""",
    "median_split": """
        SELECT "group", store_code_uc, year, quarter,
               max(CASE WHEN year = 1997 AND quarter = 4 THEN state_sales_share END)
                 OVER (PARTITION BY store_code_uc, "group") AS share_base,
               median_share, CAST(share_base >= median_share AS INTEGER) AS above_median
        FROM panel LEFT JOIN (
            SELECT "group", median(state_sales_share) AS median_share
            FROM (SELECT * FROM panel WHERE year = 1997 AND quarter = 4
                  QUALIFY store_code_uc = min(store_code_uc) OVER (PARTITION BY "group", parent_code))
            WHERE only_in_focal = 0 GROUP BY ALL) USING ("group")""",
    "store_appearances": """
        SELECT *, count(*) OVER (PARTITION BY store_code_uc, "group") AS appearances
        FROM sg WHERE year BETWEEN 1996 AND 2000""",
    "appearance_table": """
        WITH rows AS (
            SELECT *, count(*) OVER (PARTITION BY store_code_uc, "group") AS appearances
            FROM sg)
        SELECT "group", appearances, count(DISTINCT store_code_uc) AS n_stores, count(*) AS n_rows,
               count(*) / sum(count(*)) OVER (PARTITION BY "group") AS row_share,
               count(DISTINCT store_code_uc)
                 / sum(count(DISTINCT store_code_uc)) OVER (PARTITION BY "group") AS store_share
        FROM rows GROUP BY "group", appearances""",
    "store_persistence": """
        WITH rows AS (
            SELECT *, count(*) OVER (PARTITION BY parent_code, fips_state_code, year, quarter) AS n
            FROM (SELECT DISTINCT store_code_uc, parent_code, fips_state_code, year, quarter FROM sg)),
        means AS (
            SELECT *, avg(n) OVER (PARTITION BY parent_code, fips_state_code) AS mean FROM rows),
        flagged AS (SELECT DISTINCT parent_code, fips_state_code, year, quarter, n, mean FROM means)
        SELECT count(*) AS n_parent_state_periods,
               count(*) FILTER (n / mean > 0.95 AND n / mean < 1.05) / count(*) AS share_persistent,
               count(*) FILTER (abs(n - mean) < 5) / count(*) AS share_within_distance
        FROM flagged""",
    "stores_in_state": """
        WITH active AS (SELECT DISTINCT store_code_uc, year, parent_code, fips_state_code FROM sg),
        rows AS (
            SELECT *, count(*) OVER (PARTITION BY parent_code, fips_state_code, year) AS num_stores
            FROM active)
        SELECT DISTINCT parent_code, fips_state_code, year, num_stores,
               avg(num_stores) OVER (PARTITION BY parent_code, fips_state_code) AS avg_num_stores,
               num_stores / avg_num_stores AS persistence
        FROM rows""",
    "did_pooled": _did(POOLED_SPECS, "panel", None, '"group", '),
    "did_by_group": _did(CATEGORY_SPECS, "panel", '"group"', ""),
    "did_by_group_extras": _did(CATEGORY_SPECS, "panel_items", '"group"', "extras_group, "),
    "did_by_bin": _did(FLAG_SPECS, "binned", "hhi_bin", '"group", '),
    "did_single_category": _did(
        {"r1": FLAG_SPECS["r1"], "r2": FLAG_SPECS["r2"], "r3": (MULTI, STATE, False)},
        "panel", '"group"', "",
    ),
    "did_demeaned": f"""
        SELECT *, dlprice_pre - avg(dlprice_pre) OVER c AS dlprice_pre_d,
               in_focal - avg(in_focal) OVER c AS in_focal_d,
               post_in_focal - avg(post_in_focal) OVER c AS post_in_focal_d
        FROM (SELECT store_code_uc, "group", yearqtr, dlprice_pre, in_focal,
                     in_focal * (year >= {CUTOFF})::INT AS post_in_focal
              FROM panel WHERE {AWAY} AND dlprice_pre IS NOT NULL)
        WINDOW c AS (PARTITION BY "group", yearqtr)""",
    "results_wide": 'SELECT "group", ' + ", ".join(
        f"max({c}) FILTER (spec = '{s}') AS {s}_{c}" for s in CATEGORY_SPECS
        for c in ("b", "se", "n", "r2")
    ) + f" FROM ({_did(CATEGORY_SPECS, 'panel', chr(34) + 'group' + chr(34), '')}) GROUP BY ALL",
    "panel_merge": """
        SELECT c.firm_id, c.state, c.year, c.revenue, r.t_corp, r.wgt_sales, f.kappa
        FROM chain c JOIN rates r ON c.state = r.statefips AND c.year = r.year
             JOIN firms f ON c.firm_id = f.firm_id""",
    "state_year_grid": """
        SELECT firm_id, state, y AS year
        FROM (SELECT DISTINCT firm_id, state FROM chain), (SELECT unnest([2010, 2011]) AS y)""",
    "trade_pairs": """
        SELECT firm_id, year, a.state AS producing_state, b.state AS consuming_state,
               CASE WHEN a.state = b.state THEN 0::DOUBLE ELSE 0.05::DOUBLE END AS iceberg_trade_cost,
               CASE WHEN a.state = b.state THEN 0::DOUBLE ELSE 0.01::DOUBLE END
                 AS non_iceberg_trade_cost
        FROM chain a JOIN chain b USING (firm_id, year)""",
    "scenario_panel": """
        SELECT firm_id, epsilon, kappa, CAST(y AS INTEGER) AS year, CAST(s AS INTEGER) AS state,
               100::DOUBLE AS cost, 0.5::DOUBLE AS wage, 0.2::DOUBLE AS rental_rate,
               1::DOUBLE AS sales_weight,
               CASE WHEN s = 1 AND y > 0 THEN 0.35::DOUBLE ELSE 0.25::DOUBLE END AS FA_tax_rate,
               0::DOUBLE AS separate_acct_tax_rate,
               CASE WHEN s = 1 AND y = 0 THEN 0.1::DOUBLE / epsilon ELSE 0 END AS sales_tax_rate,
               0::DOUBLE AS payroll_tax_rate
        FROM firms, (VALUES (0, 4), (1, 1), (2, 3), (3, 4), (4, 6), (5, 12), (6, 40)) v(y, n),
             (SELECT unnest(generate_series(1, 50)) AS s)
        WHERE s <= n""",
    "rate_sweep": "SELECT * FROM sweep",
    "rate_update": """
        SELECT * REPLACE (CASE WHEN year >= 1998 AND state % 4 = 2 THEN tax_rate + 0.01::DOUBLE
                               ELSE tax_rate END AS tax_rate) FROM firm_panel""",
    "conditional_update": """
        SELECT * REPLACE (CASE WHEN year >= 1998 AND state = 6 THEN tax_rate + 0.04::DOUBLE
                               ELSE tax_rate END AS tax_rate) FROM firm_panel""",
    "repeat_rows": f"""
        SELECT {PARENT} AS parent_code, s_nationkey AS fips_state_code,
               CAST(count(*) OVER w AS INTEGER) AS n_stores,
               CAST(row_number() OVER (w ORDER BY s_suppkey) AS INTEGER) AS jurisdiction
        FROM supplier WINDOW w AS (PARTITION BY {PARENT}, s_nationkey)""",
    "kappa_calibration": "SELECT * FROM calibrated",
    "scaled_revenue": """
        SELECT state, year, sum(revenue) AS spending,
               sum(revenue) * 420000 / 9000000 AS revenue FROM chain GROUP BY state, year""",
    "counterfactual_prices": "SELECT firm_id, state, year, " + ", ".join(
        f"{r}_{what}" for r in ("perceived_sales_tax", "naive", "optimal")
        for what in ("price", "quantity", "revenue", "state_profits", "sales_share",
                     "state_tax_bill")
    ) + """, sales_tax_producer_price, sales_tax_consumer_price, sales_tax_quantity,
             sales_tax_profits FROM cf""",
    "profit_comparison": """
        SELECT year, sum(naive_state_profits) - sum(naive_state_tax_bill)
                 AS total_post_tax_naive_profits,
               sum(optimal_state_profits) - sum(optimal_state_tax_bill)
                 AS total_post_tax_optimal_profits,
               sum(perceived_sales_tax_state_profits) - sum(perceived_sales_tax_state_tax_bill)
                 AS total_sales_tax_profits
        FROM cf GROUP BY year""",
    "regime_long": " UNION ALL ".join(
        f"SELECT firm_id, state, year, '{r}' AS regime, {r}_price AS price FROM cf"
        for r in ("perceived_sales_tax", "naive", "optimal")
    ),
    "markup_table": """
        SELECT firm_id, state, year, optimal_price, optimal_quantity_consumed,
               sum(optimal_state_revenue) OVER f AS total_firm_revenue,
               sum(optimal_state_cost) OVER f AS total_firm_cost,
               sum(optimal_quantity_consumed) OVER f AS total_firm_sales_quantity,
               optimal_price / (optimal_state_cost / optimal_quantity_produced) - 1 AS state_markup,
               sum(optimal_state_revenue) OVER f / sum(optimal_state_cost) OVER f - 1
                 AS firm_markup,
               sum((optimal_price / (optimal_state_cost / optimal_quantity_produced) - 1)
                   * optimal_quantity_consumed) OVER f / sum(optimal_quantity_consumed) OVER f
                 AS firm_weighted_markup
        FROM solved WINDOW f AS (PARTITION BY firm_id, year)""",
    "distortion_table": """
        SELECT firm_id, state, year, count(*) OVER (PARTITION BY firm_id, year) AS n_states,
               CASE WHEN year = 1995 THEN 'Equivalent Sales Tax' ELSE n_states || ' Countries' END
                 AS year_descr,
               CASE WHEN state = 6 THEN 'Country with Higher Taxes' ELSE 'Country ' || state END
                 AS state_descr,
               optimal_price - 1 AS price_to_plot,
               CAST(nullif(list_position(['1 Countries', '2 Countries', '3 Countries',
                 '5 Countries', '10 Countries', '50 Countries', 'Equivalent Sales Tax'],
                 year_descr), 0) AS BIGINT) AS year_order
        FROM solved""",
    "separate_accounting": """
        SELECT firm_id, state, year, CASE WHEN year = 1995 THEN 1 ELSE optimal_price END
                 AS optimal_price
        FROM solved WHERE year <> 1995 OR state = 6""",
    "relabel_union": """
        WITH prices AS (
            SELECT firm_id, state, year, optimal_price - 1 AS price_to_plot,
                   max(tax_rate) FILTER (state = 6) OVER (PARTITION BY firm_id, year) AS swept_rate
            FROM solved)
        SELECT *, 'Country ' || state AS state_descr FROM prices
        UNION ALL
        SELECT * REPLACE (0 AS price_to_plot), 'Separate Accounting' FROM prices WHERE state = 6""",
    "sweep_distortion": """
        WITH prices AS (
            SELECT a.firm_id, a.state, a.year,
                   a.epsilon / (a.epsilon - 1) * a.cost * (1 + a.FA_tax_rate / a.epsilon) - 1
                     AS price_to_plot, b.FA_tax_rate AS swept_rate
            FROM sweep a JOIN sweep b USING (firm_id, year) WHERE b.state = 1)
        SELECT *, 'Country ' || state AS state_descr FROM prices
        UNION ALL
        SELECT * REPLACE (0 AS price_to_plot), 'Separate Accounting' FROM prices WHERE state = 1""",
    "implied_price": """
        SELECT firm_id, state, year,
               pow(optimal_quantity_consumed / kappa, -1 / epsilon) AS implied_price
        FROM solved""",
    "stage_round_trip": "SELECT * FROM sg",
    "apportioned_profit": """
        SELECT firm_id, year, sum(rate) AS apportioned_rate, avg(FA_tax_rate) AS naive_rate,
               sum(factor_cost) AS total_cost, sum(output) AS total_output,
               sum(sales) - sum(factor_cost) AS pre_tax_profit,
               (1 - sum(rate)) * (sum(sales) - sum(factor_cost))
                 - sum(0.01::DOUBLE * (sales - factor_cost) + 0.02::DOUBLE * sales
                       + 0.03::DOUBLE * payroll) AS after_tax_profit,
               (1 - avg(FA_tax_rate)) * (sum(sales) - sum(factor_cost))
                 - sum(0.01::DOUBLE * (sales - factor_cost) + 0.02::DOUBLE * sales
                       + 0.03::DOUBLE * payroll) AS after_tax_profit_naive
        FROM shares GROUP BY firm_id, year""",
    "apportioned_profit_trade": """
        WITH shipped AS (
            SELECT t.firm_id, t.year, producing_state AS state,
                   sum((1 - iceberg) * quantity * p) AS shipped, sum(unit_cost * quantity) AS freight
            FROM flows t JOIN factors f ON t.firm_id = f.firm_id AND t.year = f.year
                                       AND t.consuming_state = f.state
            GROUP BY ALL)
        SELECT s.firm_id, s.year, sum(rate) AS apportioned_rate, avg(FA_tax_rate) AS naive_rate,
               sum(factor_cost) AS total_cost, sum(output) AS total_output,
               sum(sales) - sum(factor_cost) AS pre_tax_profit,
               (1 - sum(rate)) * (sum(sales) - sum(factor_cost))
                 - sum(0.01::DOUBLE * (coalesce(shipped, 0) - factor_cost) + 0.02::DOUBLE * sales
                       + 0.03::DOUBLE * payroll + coalesce(freight, 0)) AS after_tax_profit,
               (1 - avg(FA_tax_rate)) * (sum(sales) - sum(factor_cost))
                 - sum(0.01::DOUBLE * (coalesce(shipped, 0) - factor_cost) + 0.02::DOUBLE * sales
                       + 0.03::DOUBLE * payroll + coalesce(freight, 0)) AS after_tax_profit_naive
        FROM shares s LEFT JOIN shipped USING (firm_id, year, state) GROUP BY s.firm_id, s.year""",
    "trade_margins": """
        SELECT firm_id, year, state, coalesce(p, 0) AS quantity_produced,
               coalesce(c, 0) AS quantity_consumed
        FROM (SELECT firm_id, year, producing_state AS state, sum(quantity) AS p
              FROM flows GROUP BY ALL)
        FULL JOIN (SELECT firm_id, year, consuming_state AS state,
                          sum((1 - iceberg) * quantity) AS c
                   FROM flows GROUP BY ALL) USING (firm_id, year, state)""",
    "state_ratios": """
        WITH priced AS (
            SELECT *, epsilon / (epsilon - 1) * cost * (1 + FA_tax_rate / epsilon) AS price,
                   kappa * pow(price, -epsilon) AS quantity,
                   quantity * (1 - FA_tax_rate) AS labour, pow(quantity, 0.25::DOUBLE) AS wage
            FROM sweep)
        SELECT firm_id, year,
               max(price) FILTER (state = 1) / max(price) FILTER (state = 2) AS price_ratio,
               max(quantity) FILTER (state = 1) / max(quantity) FILTER (state = 2) AS quantity_ratio,
               max(labour) FILTER (state = 1) / max(labour) FILTER (state = 2) AS labour_ratio,
               max(wage) FILTER (state = 1) / max(wage) FILTER (state = 2) AS wage_ratio
        FROM priced GROUP BY firm_id, year
        HAVING bool_or(state = 1) AND bool_or(state = 2)""",
    "pricing_residual": """
        SELECT firm_id, state, year,
               sum(FA_tax_rate * q) OVER f / sum(q) OVER f AS mean_rate,
               (FA_tax_rate - mean_rate) / (1 - mean_rate) AS excess_rate,
               pow(q, -1 / epsilon) - epsilon / (epsilon - excess_rate) * epsilon / (epsilon - 1) * cost
                 AS residual
        FROM factors WINDOW f AS (PARTITION BY firm_id, year)""",
}

SQL |= {
    "movement_files": """
        SELECT lpad(CAST(ascii(p_type) * 100 + length(p_type) AS VARCHAR), 4, '0') AS "group",
               CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n_rows,
               count(DISTINCT l_suppkey) AS n_stores, count(DISTINCT l_partkey) AS n_products,
               CAST(sum(l_quantity) AS BIGINT) AS units,
               CAST(round(sum(l_extendedprice * 100)) AS BIGINT) AS cents,
               CAST(sum(l_linenumber) AS BIGINT) AS multiples,
               CAST(min(strftime(l_shipdate, '%Y%m%d')) AS INTEGER) AS first_week,
               CAST(max(strftime(l_shipdate, '%Y%m%d')) AS INTEGER) AS last_week
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "movement_file_quarter": SQL["movement_quarter"],
    "store_files": SQL["stores_dim"],
    "upc_version_files": SQL["upc_versions"],
    "extras_file": f"""
        SELECT upc, CAST(y AS INTEGER) AS year, "group", flavor_code, size_code
        FROM attrs, (SELECT unnest({YEARS}) AS y)""",
    "trade_cost_file": """
        SELECT producing_state, consuming_state, firm_id, year, iceberg AS iceberg_trade_cost,
               unit_cost AS non_iceberg_trade_cost
        FROM flows""",
}

SQL |= {
    "product_panel_reports": f"""
        WITH stores_last AS (
            SELECT store_code_uc, year, CASE WHEN max(quarter) >= 3 THEN 300000 + any_value(s_nationkey)
                                             ELSE any_value({PARENT}) END AS parent_code,
                   any_value(s_nationkey) AS fips_state_code
            FROM moves JOIN supplier ON store_code_uc = s_suppkey GROUP BY store_code_uc, year),
        versions_last AS (
            SELECT upc, year, 1 + (any_value(p_size) + max(quarter)) % 3 AS upc_ver_uc
            FROM moves JOIN part ON upc = p_partkey GROUP BY upc, year)
        SELECT p.* EXCLUDE (parent_code, fips_state_code), s.parent_code, s.fips_state_code, v.upc_ver_uc,
               revenue / nullif(quantity, 0) AS price
        FROM products p LEFT JOIN stores_last s USING (store_code_uc, year) LEFT JOIN versions_last v USING (upc, year)""",
    "extras_collapse_reports": """
        WITH reported AS (
            SELECT DISTINCT upc, year, concat(p_brand, '-', quarter % 2) AS flavor_code,
                   CASE WHEN (p_size + quarter) % 4 <> 0 THEN p_size - quarter END AS size_code
            FROM moves JOIN part ON upc = p_partkey),
        best AS (
            SELECT * FROM reported QUALIFY row_number() OVER (
                PARTITION BY upc, year ORDER BY flavor_code DESC, size_code DESC NULLS LAST) = 1)
        SELECT year, quarter, fips_state_code, parent_code, store_code_uc, "group",
               md5('{' || concat_ws(',', '"flavor_code":"' || flavor_code || '"',
                                         '"size_code":' || size_code) || '}') AS extras_group,
               sum(revenue) AS revenue, sum(quantity) AS quantity
        FROM products LEFT JOIN best USING (upc, year) GROUP BY ALL""",
    "hhi_bin_panel_reports": f"""
        SELECT sg.*, hhi_bin
        FROM sg LEFT JOIN (SELECT "group", arg_max(hhi_bin, hhi) AS hhi_bin
                           FROM ({SQL["hhi_bins_extras"]}) GROUP BY ALL) USING ("group")
        WHERE year BETWEEN 1996 AND 2000""",
    "evaluated_profit": SQL["apportioned_profit_trade"],
}

CTE["binned"] = 'SELECT panel.*, hhi_bin FROM panel LEFT JOIN bins USING ("group")'
ORDER.append("binned")

for _name, _spec in POOLED_SPECS.items():
    SQL[f"did_{_name}"] = _did({_name: _spec}, "panel", None, '"group", ')


def oracle(name: str, doubles: Sequence[str] | None = None) -> str:
    """Complete statement: the CTEs it needs and the rounding both sides share."""
    body = SQL[name]
    ctes = ",\n".join(f"{c} AS MATERIALIZED ({CTE[c]})" for c in _needs(body))
    head = f"WITH {ctes},\n" if ctes else "WITH "
    columns = DOUBLES[name] if doubles is None else doubles
    rounded = ", ".join(
        f'floor("{c}" * 1e{digits_of(c)} + {EDGE}::DOUBLE) / 1e{digits_of(c)} AS "{c}"'
        for c in columns
    )
    final = f"SELECT * REPLACE ({rounded}) FROM answer" if rounded else "SELECT * FROM answer"
    return f"{head}answer AS ({body})\n{final}"

