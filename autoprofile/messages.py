"""The wording of results, as format strings.

Fixed values: all but the ``*_DETAIL`` texts and NESTED_COLUMN, which are our own wording.

``%`` placeholders are filled by ``F.format_string``; texts with thousands separators are
put together with ``F.format_number`` where they are used.
"""

# data dictionary
EMPTY_COLUMN = "Column is fully empty"
CONSTANT_COLUMN = "Column has only one unique value: %s"
IDENTIFIER_COLUMN = "High-cardinality identifier column (unique ratio=%.2f%%)"
NESTED_COLUMN = "Nested type"
NOISY_DATES = "Mixed datetime parsing success (%s%%); may be noisy dates."
TEXT_NUMBERS = "Numeric values stored as text; will be coerced during analysis."

# quality issues
HIGH_NULLS = "High null rate: %.1f%%"
MIXED_TYPES = "Mixed value types detected: %s"
NON_STRINGS = "Non-string values mixed with strings: %s"
EDGE_SPACE = "%d value(s) have leading/trailing whitespace"
OUTLIERS = "%d outlier(s) detected (IQR method, range: [%.2f, %.2f])"
SKEWED = "Skewed distribution (skewness=%.2f)"
FUTURE_DATES = "%d date(s) are in the future"
OLD_DATES = "%d date(s) are before 1900 (possibly erroneous)"
LABEL_VARIANTS = "%d inconsistent label variant(s) found (e.g. case/whitespace differences)"

# KPIs: name, formula, description
TOTAL_KPI = ("total_%s", "SUM(%s)", "Total %s across all records")
AVERAGE_KPI = ("avg_%s", "AVG(%s)", "Average %s")
RATIO_KPI = ("revenue_per_unit", "SUM(%s) / SUM(%s)", "Average revenue generated per unit sold")
COUNT_KPI = ("record_count_by_%s", "COUNT(*) GROUP BY %s", "Number of records per %s")

# chart titles
NULLS_CHART = "Missing Value Analysis"
HISTOGRAM_CHART = "Distribution of {}"
BOX_CHART = "Box Plot: {}"
BAR_CHART = "Distribution of {}"
LINE_CHART = "Time Trend: {}"
HEATMAP_CHART = "Correlation Heatmap"
SCATTER_CHART = "Scatter: {} vs {}"
SEGMENT_CHART = "{} by {}"
KPI_CHART = "KPI Overview"

# insights
OVERVIEW_TITLE = "Dataset contains %s records across %d columns"
OVERVIEW_DETAIL = "%s%% of rows are complete; %s duplicate rows."
NULLS_TITLE = "%d column(s) have high missing value rates"
NULLS_DETAIL = "Columns with >30%% nulls: %s."
EXTREME_TITLE = "'%s' has extreme outliers (max=%s, mean=%s)"
EXTREME_DETAIL = "The maximum is %.1f times the average."
CORRELATION_TITLE = "Strong %s between '%s' and '%s' (r=%s)"
CORRELATION_DETAIL = "The two measures move together; this alone says nothing about a cause."
TREND_TITLE = "'%s' shows a %s trend over time (R²=%.2f)"
TREND_DETAIL = "A straight line explains %.0f%% of the variance of %s."
SEGMENT_TITLE = "'%s' dominates '%s' by %s (%.1f%%)"
SEGMENT_DETAIL = "The top segment holds %.1f%% of the %s shown."
DOMINANT_TITLE = "'%s' is dominated by '%s' (%.0f%% of values)"
DOMINANT_DETAIL = "Averages over all rows mostly describe this one value."
