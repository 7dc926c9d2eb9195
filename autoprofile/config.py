"""Thresholds and switches for every analysis, as immutable dataclasses."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any

# Words that read as a truth value, lower case.
TRUE_WORDS = ("true", "yes", "1", "y", "t")
FALSE_WORDS = ("false", "no", "0", "n", "f")

# Canonical business name -> column-name parts that mean the same.
# Pass as ``SemanticRules(synonyms=BUSINESS_SYNONYMS)``; the default is no synonyms.
BUSINESS_SYNONYMS: dict[str, tuple[str, ...]] = {
    "amount": ("amt", "value", "val", "sum"),
    "quantity": ("qty", "count", "cnt", "num"),
    "date": ("dt", "created_at", "updated_at", "timestamp"),
    "revenue": ("rev", "sales", "income", "earnings"),
    "customer": ("client", "cust", "buyer", "account"),
    "product": ("item", "sku", "goods", "merchandise"),
    "region": ("area", "zone", "territory", "geo"),
    "category": ("cat", "type", "class", "segment"),
}


@dataclass(frozen=True)
class IngestRules:
    header_scan_rows: int = 20
    prefer_largest: bool = True
    max_rows: int | None = None


@dataclass(frozen=True)
class SchemaRules:
    datetime_share: float = 0.85
    numeric_share: float = 0.90
    categorical_max_ratio: float = 0.20
    identifier_min_ratio: float = 0.95
    true_words: tuple[str, ...] = TRUE_WORDS
    false_words: tuple[str, ...] = FALSE_WORDS
    #: column -> business type, wins over inference
    type_overrides: Mapping[str, str] = field(default_factory=dict)
    #: False keeps mostly-unique float columns as measures instead of identifiers
    float_identifiers: bool = True
    #: "exact", or "approx": sketches, with an exact count only near a threshold
    distinct: str = "exact"


@dataclass(frozen=True)
class QualityRules:
    iqr_factor: float = 1.5
    zscore_limit: float = 3.0
    high_null_share: float = 0.50
    skewness_limit: float = 1.0


@dataclass(frozen=True)
class SemanticRules:
    auto_kpis: bool = True
    standardize_names: bool = True
    synonyms: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    #: "token" replaces whole ``_``-separated parts, "substring" any occurrence
    match: str = "token"
    #: also describe identifier columns, as entities
    include_identifiers: bool = False
    #: values listed for a dimension, and dimensions whose values are counted as KPIs
    dimension_values: int = 50
    count_kpis: int = 2


@dataclass(frozen=True)
class AnalysisRules:
    top_n: int = 15
    min_correlation_columns: int = 2
    strong_correlation: float = 0.7
    min_time_points: int = 10
    granularity: str = "month"
    segment_dimensions: int = 4
    segment_measures: int = 3
    null_label: str = "nan"


@dataclass(frozen=True)
class ChartRules:
    """How many charts of each kind there are at most, and what they show."""

    max_charts: int = 30
    max_scatter_points: int = 5000
    histograms: int = 6
    box_plots: int = 6
    bar_charts: int = 6
    bar_categories: int = 15
    trends_per_time_column: int = 3
    scatter_plots: int = 2
    segment_bars: int = 4
    kpi_measures: int = 6


@dataclass(frozen=True)
class InsightRules:
    """From where on a finding is worth a sentence, and how many of a kind there are."""

    high_null_pct: float = 30
    extreme_factor: float = 5
    correlations: int = 3
    trends_per_time_column: int = 2
    min_trend_r2: float = 0.5
    segment_results: int = 3
    dominant_pct: float = 60
    names: int = 5


@dataclass(frozen=True)
class ReportRules:
    max_insights: int = 20


@dataclass(frozen=True)
class Config:
    ingest: IngestRules = field(default_factory=IngestRules)
    schema: SchemaRules = field(default_factory=SchemaRules)
    quality: QualityRules = field(default_factory=QualityRules)
    semantic: SemanticRules = field(default_factory=SemanticRules)
    analysis: AnalysisRules = field(default_factory=AnalysisRules)
    charts: ChartRules = field(default_factory=ChartRules)
    insights: InsightRules = field(default_factory=InsightRules)
    report: ReportRules = field(default_factory=ReportRules)

    @classmethod
    def from_mapping(cls, values: Mapping[str, Any]) -> "Config":
        """Build from nested dicts; an unknown section or key raises ``KeyError``."""
        return _build(cls, values, "config")


def _build(cls: type, values: Mapping[str, Any], where: str) -> Any:
    known = {f.name: f for f in fields(cls)}
    unknown = set(values) - set(known)
    if unknown:
        raise KeyError(f"unknown keys in {where}: {sorted(unknown)}")
    defaults = cls()
    kwargs = {}
    for name, value in values.items():
        current = getattr(defaults, name)
        if is_dataclass(current) and isinstance(value, Mapping):
            value = _build(type(current), value, f"{where}.{name}")
        elif isinstance(current, tuple):
            value = tuple(value)
        kwargs[name] = value
    return cls(**kwargs)
