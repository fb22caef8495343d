"""Parameters of the operators, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # quality gates
    min_words: int = 2
    max_words: int = 100
    quality_threshold: float = 0.30
    context_threshold: float = 0.30
    tfidf_weight: float = 0.4
    novelty_weight: float = 0.6
    novelty_k: int = 3
    # duplicates
    similarity: float = 0.95
    edit_distance: float = 0.15
    top_k: int = 5
    # search
    recall_k: int = 50
    recall_extra: int = 20
    min_similarity: float = 0.50
    relative_cut: float = 0.06
    weight_zh: float = 0.40
    weight_translated: float = 0.25
    weight_en: float = 0.15
    weight_tag: float = 0.12
    weight_quality: float = 0.06
    weight_occurrence: float = 0.02
    occurrence_saturation: int = 50
    rebuild_share: float = 0.05
    # line and segment merging
    line_gap: float = 1.00
    line_words: int = 50
    line_similarity: float = 0.68
    segment_gap: float = 1.5
    segment_hard_gap: float = 1.5
    segment_duration: float = 12.0
    segment_words: int = 40
    clause_words: int = 8
    case_gap: float = 0.6
    # alignment
    window: float = 30.0
    weight_text: float = 0.55
    weight_vector: float = 0.35
    order_bonus: float = 0.10
    order_penalty: float = 0.15
    min_length_ratio: float = 0.4
    ambiguous_margin: float = 0.08
    short_words: int = 3
    short_similarity: float = 0.9
    least_similarity: float = 0.3
    least_confidence: float = 0.5
    # clips
    high_confidence: float = 0.85
    low_confidence: float = 0.60
    fallback_confidence: float = 0.65
    clip_max: float = 15.0
    clip_min: float = 1.0
    pad_start: float = 0.5
    pad_end: float = 1.0
    context_extra: float = 6.0
    scene_gap: float = 1.5
    neighbour_max: float = 3.0
    snap_max: float = 1.5
    snap_min: float = 0.3
    anchor_radius: float = 5.0

    def __post_init__(self) -> None:
        total = self.weight_zh + self.weight_translated + self.weight_en + self.weight_tag + self.weight_quality + self.weight_occurrence
        if abs(total - 1) > 1e-6:
            raise ValueError(f"the weights of the ranking must add up to 1, not {total}")


DEFAULT = Params()
