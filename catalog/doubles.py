"""Double columns of each query, the ones the comparison rounds."""

from __future__ import annotations

DOUBLES: dict[str, tuple[str, ...]] = {
    "stores_dim": (),
    "upc_versions": (),
    "categories": (),
    "movement_files": (),
    "movement_file_quarter": ("revenue", "quantity"),
    "store_files": (),
    "upc_version_files": (),
    "extras_file": (),
    "trade_cost_file": ("iceberg_trade_cost", "non_iceberg_trade_cost"),
    "movement_quarter": ("revenue", "quantity"),
    "product_panel_reports": ("revenue", "quantity", "price"),
    "extras_collapse_reports": ("revenue", "quantity"),
    "hhi_bin_panel_reports": ("revenue", "quantity"),
    "product_panel": ("revenue", "quantity", "price"),
    "extras_groups": (),
    "extras_collapse": ("revenue", "quantity"),
    "store_group_collapse": ("revenue", "quantity"),
    "parent_state": ("revenue", "quantity", "state_sales_share"),
    "frequent_groups": ("revenue", "quantity"),
    "uniform_price": ("price_mean", "price_sd", "total_revenue", "mode_share", "hhi", "coef_var"),
    "price_concentration": ("hhi",),
    "hhi_bins": ("hhi",),
    "hhi_bins_extras": ("hhi",),
    "hhi_bin_panel": ("revenue", "quantity"),
    "tax_changes": ("t_corp", "wgt_sales", "t_x", "dt_x", "dt_corp", "dwgt_sales", "mag"),
    "sales_weight_changes": ("t_corp", "wgt_sales", "t_x", "dt_x", "dt_corp", "dwgt_sales"),
    "exposure_flags": ("revenue", "quantity", "state_sales_share", "focal_share", "total_revenue"),
    "exposure_panel": (
        "revenue", "quantity", "state_sales_share", "focal_share", "gross_revenue", "price",
        "lprice", "dlprice_pre", "focal_share_pre",
    ),
    "exposure_panel_extras": (
        "revenue", "quantity", "state_sales_share", "focal_share", "gross_revenue", "price",
        "lprice", "dlprice_pre", "focal_share_pre",
    ),
    "baseline_log_change": ("revenue", "quantity", "price", "lprice", "dlprice_pre"),
    "parent_summary": (
        "exposed_revenue_share", "focal_revenue_share", "mean_presence", "mean_focal_share",
    ),
    "focal_spillover": ("tot_sales", "sales_share"),
    "focal_sales_mix": ("mean_sales", "t_corp", "t_x"),
    "one_way_table": ("share",),
    "two_way_table": (),
    "distinct_counts": (),
    "filtered_means": (
        "price_only", "price_not_only", "revenue_only", "revenue_not_only",
        "revenue_there_exposed", "revenue_there_other",
    ),
    "median_split": ("share_base", "median_share"),
    "store_appearances": ("revenue", "quantity"),
    "appearance_table": ("row_share", "store_share"),
    "store_persistence": ("share_persistent", "share_within_distance"),
    "stores_in_state": ("avg_num_stores", "persistence"),
    "did_r1": ("b", "se", "r2"),
    "did_r2": ("b", "se", "r2"),
    "did_r3": ("b", "se", "r2"),
    "did_r4": ("b", "se", "r2"),
    "did_r5": ("b", "se", "r2"),
    "did_r6": ("b", "se", "r2"),
    "did_r7": ("b", "se", "r2"),
    "did_r8": ("b", "se", "r2"),
    "did_r9": ("b", "se", "r2"),
    "did_r10": ("b", "se", "r2"),
    "did_r11": ("b", "se", "r2"),
    "did_r12": ("b", "se", "r2"),
    "did_r13": ("b", "se", "r2"),
    "did_pooled": ("b", "se", "r2"),
    "did_by_group": ("b", "se", "r2"),
    "did_by_group_extras": ("b", "se", "r2"),
    "did_by_bin": ("b", "se", "r2"),
    "did_single_category": ("b", "se", "r2"),
    "did_demeaned": ("dlprice_pre", "dlprice_pre_d", "in_focal_d", "post_in_focal_d"),
    "results_wide": (
        "r1_b", "r1_se", "r1_r2", "r2_b", "r2_se", "r2_r2", "r3_b", "r3_se", "r3_r2",
        "r4_b", "r4_se", "r4_r2", "r5_b", "r5_se", "r5_r2", "r6_b", "r6_se", "r6_r2",
        "r7_b", "r7_se", "r7_r2", "r2a_b", "r2a_se", "r2a_r2", "r3a_b", "r3a_se", "r3a_r2",
        "r4a_b", "r4a_se", "r4a_r2",
    ),
    "panel_merge": ("revenue", "t_corp", "wgt_sales", "kappa"),
    "state_year_grid": (),
    "trade_pairs": ("iceberg_trade_cost", "non_iceberg_trade_cost"),
    "scenario_panel": (
        "epsilon", "kappa", "cost", "wage", "rental_rate", "sales_weight", "FA_tax_rate",
        "separate_acct_tax_rate", "sales_tax_rate", "payroll_tax_rate",
    ),
    "rate_sweep": ("epsilon", "kappa", "cost", "FA_tax_rate"),
    "rate_update": ("revenue", "epsilon", "cost", "tax_rate"),
    "conditional_update": ("revenue", "epsilon", "cost", "tax_rate"),
    "repeat_rows": (),
    "kappa_calibration": ("revenue", "epsilon", "cost", "tax_rate", "price", "quantity", "kappa"),
    "scaled_revenue": ("spending", "revenue"),
    "counterfactual_prices": (
        "perceived_sales_tax_price", "perceived_sales_tax_quantity",
        "perceived_sales_tax_revenue", "perceived_sales_tax_state_profits",
        "perceived_sales_tax_sales_share", "perceived_sales_tax_state_tax_bill",
        "naive_price", "naive_quantity", "naive_revenue", "naive_state_profits",
        "naive_sales_share", "naive_state_tax_bill", "optimal_price", "optimal_quantity",
        "optimal_revenue", "optimal_state_profits", "optimal_sales_share",
        "optimal_state_tax_bill", "sales_tax_producer_price", "sales_tax_consumer_price",
        "sales_tax_quantity", "sales_tax_profits",
    ),
    "profit_comparison": (
        "total_post_tax_naive_profits", "total_post_tax_optimal_profits",
        "total_sales_tax_profits",
    ),
    "regime_long": ("price",),
    "markup_table": (
        "optimal_price", "optimal_quantity_consumed", "total_firm_revenue",
        "total_firm_cost", "total_firm_sales_quantity", "state_markup", "firm_markup",
        "firm_weighted_markup",
    ),
    "distortion_table": ("price_to_plot",),
    "separate_accounting": ("optimal_price",),
    "relabel_union": ("price_to_plot", "swept_rate"),
    "sweep_distortion": ("price_to_plot", "swept_rate"),
    "implied_price": ("implied_price",),
    "stage_round_trip": ("revenue", "quantity"),
    "apportioned_profit": (
        "apportioned_rate", "naive_rate", "total_cost", "total_output", "pre_tax_profit",
        "after_tax_profit", "after_tax_profit_naive",
    ),
    "evaluated_profit": (
        "apportioned_rate", "naive_rate", "total_cost", "total_output", "pre_tax_profit",
        "after_tax_profit", "after_tax_profit_naive",
    ),
    "apportioned_profit_trade": (
        "apportioned_rate", "naive_rate", "total_cost", "total_output", "pre_tax_profit",
        "after_tax_profit", "after_tax_profit_naive",
    ),
    "trade_margins": ("quantity_produced", "quantity_consumed"),
    "state_ratios": ("price_ratio", "quantity_ratio", "labour_ratio", "wage_ratio"),
    "pricing_residual": ("mean_rate", "excess_rate", "residual"),
}
