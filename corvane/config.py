"""All settings that change results, in one frozen object that is passed on explicitly."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class EngineConfig:
    child_target_tokens: int = 256
    parent_max_tokens: int = 1000
    embedding_dims: int = 64
    full_context_threshold: int = 30000
    context_budget: int = 40000
    top_k_children: int = 60
    similarity_floor: float = 0.3
    depth_decay_rate: float = 0.05
    depth_floor: float = 0.80
    decomposition_mode: str = "rule_based"
    reranker: str = "none"
    rerank_top_n: int = 20
    rerank_similarity_floor: float = 0.15
    max_expansion_depth: int = 5
    candidates_per_iteration: int = 5
    candidates_to_score: int = 20
    map_limit: int = 100
    min_candidate_score: float = 0.12
    locality_enabled: bool = True
    locality_radius: int = 1
    saturation_ratio: float = 0.8
    redundancy_ceiling: float = 0.85
    cliff_threshold: float = 0.15
    cliff_rank: int = 5
    plateau_variance: float = 0.02
    plateau_top_n: int = 10
    diminishing_delta: float = 0.03
    mediocre_floor: float = 0.25
    confidence_floor: float = 0.3
    locality_min_score: float = 0.3
    response_tokens: int = 30000
    citations_tokens: int = 1500
    images_tokens: int = 500
    timeout_s: int = 120
    #: The most queries of one batch: their vectors go to every executor.
    max_queries: int = 4096

    def with_(self, **changes: object) -> EngineConfig:
        return replace(self, **changes)

    def budget(self, override: int | None = None) -> int:
        """The context budget; an override counts, but is at least 1."""
        return self.context_budget if override is None else max(1, override)

    def threshold(self, budget: int) -> int:
        """The full-context threshold, never above the budget."""
        return min(self.full_context_threshold, budget)

    def effective_mediocre_floor(self) -> float:
        """Raw similarities aren't calibrated, so the floor is at most 0.35 without a reranker."""
        return min(self.mediocre_floor, 0.35) if self.reranker.lower() == "none" else self.mediocre_floor
