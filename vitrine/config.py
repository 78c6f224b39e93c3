"""Weights, thresholds and limits, with the same checks the service makes at start-up."""

from __future__ import annotations

from dataclasses import dataclass, field

SCORE_DECIMALS = 9
"""Scores are compared at this many decimals, so summation order cannot decide a tie."""


def _sums_to_one(label: str, *weights: float) -> None:
    if abs(sum(weights) - 1.0) > 1e-6:
        raise ValueError(f"{label} weights must sum to 1.0, got {sum(weights)}")


@dataclass(frozen=True)
class SearchConfig:
    image_dim: int = 512
    text_dim: int = 384
    top_k: int = 10
    max_top_k: int = 100
    image_weight: float = 0.7
    text_weight: float = 0.3


@dataclass(frozen=True)
class RerankConfig:
    pool: int = 50
    batch_size: int = 16


@dataclass(frozen=True)
class EnrichConfig:
    confidence_threshold: float = 0.60
    max_tags: int = 20
    completeness_weight: float = 0.50
    confidence_weight: float = 0.30
    consistency_weight: float = 0.20


@dataclass(frozen=True)
class DuplicateConfig:
    threshold: float = 0.90
    top_k: int = 10
    image_weight: float = 0.35
    text_weight: float = 0.25
    metadata_weight: float = 0.20
    attribute_weight: float = 0.20

    def __post_init__(self) -> None:
        _sums_to_one("duplicate", self.image_weight, self.text_weight,
                     self.metadata_weight, self.attribute_weight)


@dataclass(frozen=True)
class VerifyConfig:
    cross_encoder_threshold: float = 0.95
    require_same_brand: bool = False
    require_same_category: bool = False
    max_price_difference_ratio: float = 0.25
    cross_encoder_weight: float = 0.7
    business_rules_weight: float = 0.3
    title_similarity_threshold: float = 0.85
    category_match_ratio: float = 0.90

    def __post_init__(self) -> None:
        _sums_to_one("verification", self.cross_encoder_weight, self.business_rules_weight)


@dataclass(frozen=True)
class RecommendConfig:
    top_k: int = 10
    diversity: bool = True
    overfetch: int = 3
    similarity_weight: float = 0.55
    attribute_weight: float = 0.20
    tag_weight: float = 0.15
    quality_weight: float = 0.10
    high_score: float = 0.7
    max_explanation_tags: int = 3
    cache_ttl_seconds: int = 3600

    def __post_init__(self) -> None:
        _sums_to_one("recommendation", self.similarity_weight, self.attribute_weight,
                     self.tag_weight, self.quality_weight)


@dataclass(frozen=True)
class PricingConfig:
    top_k: int = 20
    strategy: str = "trimmed_mean"
    trim_ratio: float = 0.1
    min_comparables: int = 3
    outlier_iqr_multiplier: float = 1.5
    min_for_outliers: int = 4
    restrict_to_same_category: bool = True
    min_similarity: float = 0.50
    high_score: float = 0.7
    medium_score: float = 0.4

    def __post_init__(self) -> None:
        if self.strategy not in ("median", "weighted_average", "trimmed_mean"):
            raise ValueError(f"unknown pricing strategy {self.strategy!r}")


@dataclass(frozen=True)
class UsageConfig:
    window_days: int = 7
    retention_days: int = 90
    daily_quota: int = 10_000
    minute_quota: int = 120
    audit_cap: int = 1000
    audit_limit: int = 100
    history_cap: int = 20


@dataclass(frozen=True)
class JobConfig:
    max_retries: int = 5
    retry_delay_seconds: float = 5.0
    timeout_seconds: int = 300


@dataclass(frozen=True)
class IntakeConfig:
    max_bytes: int = 10 * 1024 * 1024
    max_dimension_px: int = 8000
    extensions: tuple[str, ...] = (".jpg", ".jpeg", ".png", ".webp")
    mime_types: tuple[str, ...] = ("image/jpeg", "image/png", "image/webp")
    image_formats: tuple[str, ...] = ("JPEG", "PNG", "WEBP")


@dataclass(frozen=True)
class Config:
    search: SearchConfig = field(default_factory=SearchConfig)
    rerank: RerankConfig = field(default_factory=RerankConfig)
    enrich: EnrichConfig = field(default_factory=EnrichConfig)
    duplicate: DuplicateConfig = field(default_factory=DuplicateConfig)
    verify: VerifyConfig = field(default_factory=VerifyConfig)
    recommend: RecommendConfig = field(default_factory=RecommendConfig)
    pricing: PricingConfig = field(default_factory=PricingConfig)
    usage: UsageConfig = field(default_factory=UsageConfig)
    jobs: JobConfig = field(default_factory=JobConfig)
    intake: IntakeConfig = field(default_factory=IntakeConfig)


DEFAULTS = Config()
