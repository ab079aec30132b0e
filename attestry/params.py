"""Thresholds and sizes, all overridable per job."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    manufacturer_match: float = 0.86
    brand_match: float = 0.86
    pair_confidence: float = 0.98
    fallback_cap: float = 0.65
    cluster_ratio: float = 96.0
    category_cutoff: float = 55.0
    classify_accept: float = 0.42
    classify_sanity: float = 0.75
    classify_margin: float = 0.03
    classify_limit: int = 10
    class_pool: int = 128
    attribute_match: float = 0.90
    verification_confidence: float = 0.80
    mobile_target: int = 60
    page_text_limit: int = 12000
    # rows per task-side group and entries per block in exhaustive scoring
    score_rows: int = 20_000
    score_block: int = 4_096


DEFAULTS = Params()
