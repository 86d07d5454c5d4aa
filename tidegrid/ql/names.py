"""The function names of the query language, as public documentation lists them."""

AGGREGATES = frozenset(
    """any avg bottomk bottomk_avg bottomk_last bottomk_max bottomk_median bottomk_min count count_values distinct
    geomean group histogram limitk mad max median min mode outliers_iqr outliers_mad outliersk quantile quantiles
    share stddev stdvar sum sum2 topk topk_avg topk_last topk_max topk_median topk_min zscore""".split()
)
ROLLUPS = frozenset(
    """absent_over_time aggr_over_time ascent_over_time avg_over_time changes changes_prometheus count_eq_over_time
    count_gt_over_time count_le_over_time count_ne_over_time count_over_time count_values_over_time
    decreases_over_time default_rollup delta delta_prometheus deriv deriv_fast descent_over_time distinct_over_time
    duration_over_time first_over_time geomean_over_time histogram_over_time hoeffding_bound_lower
    hoeffding_bound_upper holt_winters idelta ideriv increase increase_prometheus increase_pure increases_over_time
    integrate irate lag last_over_time lifetime mad_over_time max_over_time median_over_time min_over_time
    mode_over_time outlier_iqr_over_time predict_linear present_over_time quantile_over_time quantiles_over_time
    range_over_time rate rate_over_sum rate_prometheus resets rollup rollup_candlestick rollup_delta rollup_deriv
    rollup_increase rollup_rate rollup_scrape_interval scrape_interval share_eq_over_time share_gt_over_time
    share_le_over_time stale_samples_over_time stddev_over_time stdvar_over_time sum2_over_time sum_eq_over_time
    sum_gt_over_time sum_le_over_time sum_over_time tfirst_over_time timestamp timestamp_with_name
    tlast_change_over_time tlast_over_time tmax_over_time tmin_over_time zscore_over_time""".split()
)
TRANSFORMS = frozenset(
    """abs absent acos acosh asin asinh atan atanh bitmap_and bitmap_or bitmap_xor buckets_limit ceil clamp clamp_max
    clamp_min cos cosh day_of_month day_of_week day_of_year days_in_month deg drop_common_labels drop_empty_series
    end exp floor histogram_avg histogram_fraction histogram_quantile histogram_quantiles histogram_share
    histogram_stddev histogram_stdvar hour interpolate keep_last_value keep_next_value label_copy label_del
    label_graphite_group label_join label_keep label_lowercase label_map label_match label_mismatch label_move
    label_replace label_set label_transform label_uppercase label_value labels_equal limit_offset ln log10 log2
    minute month now pi prometheus_buckets rad rand rand_exponential rand_normal range_avg range_first range_last
    range_linear_regression range_mad range_max range_min range_normalize range_quantile range_stddev range_stdvar
    range_sum range_trim_outliers range_trim_spikes range_trim_zscore range_zscore remove_resets round running_avg
    running_max running_min running_sum scalar sgn sin sinh smooth_exponential sort sort_by_label
    sort_by_label_desc sort_by_label_numeric sort_by_label_numeric_desc sort_desc sqrt start step tan tanh time
    timezone_offset union vector year""".split()
)
# Rollups that keep the metric name.
ROLLUPS_KEEP_NAME = frozenset(
    """avg_over_time default_rollup first_over_time geomean_over_time hoeffding_bound_lower hoeffding_bound_upper
    holt_winters last_over_time max_over_time median_over_time min_over_time mode_over_time predict_linear
    quantile_over_time quantiles_over_time rollup rollup_candlestick timestamp_with_name""".split()
)
# Rollups whose window is widened to the scrape interval if none is given.
ROLLUPS_WIDEN = frozenset("default_rollup deriv deriv_fast ideriv irate rate rate_over_sum rollup rollup_candlestick rollup_deriv rollup_rate rollup_scrape_interval scrape_interval timestamp".split())
# Rollups that look at the sample before the window, and read five minutes further back for it.
ROLLUPS_LOOK_BACK = frozenset(
    """ascent_over_time changes decreases_over_time default_rollup delta deriv_fast descent_over_time idelta ideriv
    increase increase_pure increases_over_time integrate irate lag lifetime rate resets rollup rollup_candlestick
    rollup_delta rollup_deriv rollup_increase rollup_rate rollup_scrape_interval scrape_interval
    tlast_change_over_time""".split()
)
ROLLUPS_RESET = frozenset("increase increase_prometheus increase_pure irate rate rate_prometheus rollup_increase rollup_rate".split())
TRANSFORMS_KEEP_NAME = frozenset(
    """ceil clamp clamp_max clamp_min floor interpolate keep_last_value keep_next_value range_avg range_first
    range_last range_linear_regression range_max range_min range_normalize range_quantile range_stddev range_stdvar
    range_trim_outliers range_trim_spikes range_trim_zscore range_sum round running_avg running_max running_min
    running_sum smooth_exponential label_copy label_del label_graphite_group label_join label_keep label_lowercase
    label_map label_match label_mismatch label_move label_replace label_set label_transform label_uppercase
    labels_equal limit_offset drop_common_labels drop_empty_series sort sort_desc sort_by_label sort_by_label_desc
    sort_by_label_numeric sort_by_label_numeric_desc union vector buckets_limit""".split()
)
