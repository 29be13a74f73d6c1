"""Parameters of all operators, with their defaults. Nothing is read from the environment."""

from __future__ import annotations

from dataclasses import dataclass, field

# Half-lives in days of each category of item.
HALF_LIVES = {"debug": 7.0, "context": 14.0, "research": 30.0, "decision": 90.0, "pattern": 180.0, "checkpoint": 14.0, "default": 30.0}

# The types of edges between items, and which of them run one way.
EDGE_TYPES = ("SIMILAR_TO", "MENTIONS", "MEMORY_FOLLOWS", "SUPERSEDES", "PROMOTED_FROM", "COMPACTED_FROM", "CO_OCCURS", "CAUSED_BY", "RELATED_TASK")
DIRECTED_TYPES = ("MEMORY_FOLLOWS", "SUPERSEDES", "PROMOTED_FROM", "CAUSED_BY", "COMPACTED_FROM")
SYMMETRIC_STORED = ("SIMILAR_TO", "CO_OCCURS")
PROVENANCE_TYPES = ("SUPERSEDES", "PROMOTED_FROM", "COMPACTED_FROM")

# The edge types that each recall intent follows.
INTENT_TYPES = {
    "temporal_recall": ("MEMORY_FOLLOWS", "SIMILAR_TO"),
    "procedural_recall": ("PROMOTED_FROM", "SIMILAR_TO", "MENTIONS"),
    "decision_recall": ("SUPERSEDES", "SIMILAR_TO", "PROMOTED_FROM"),
    "debug_recall": ("CAUSED_BY", "SIMILAR_TO", "MENTIONS"),
    "entity_recall": ("MENTIONS", "CO_OCCURS"),
    "provenance_recall": ("PROMOTED_FROM", "COMPACTED_FROM", "SUPERSEDES"),
    "general": ("SIMILAR_TO", "MENTIONS", "MEMORY_FOLLOWS"),
}


@dataclass(frozen=True)
class Settings:
    top_k_vector: int = 50
    top_k_final: int = 15
    rrf_k: int = 60
    similar_threshold: float = 0.82
    similar_pool: int = 30
    similar_top: int = 10
    duplicate_threshold: float = 0.92
    conflict_low: float = 0.70
    mmr_lambda: float = 0.7
    hub_degree: int = 50
    per_entity_cap: int = 30
    min_shared: int = 2
    temporal_weight: float = 0.30
    frequency_weight: float = 0.10
    importance_weight: float = 0.05
    half_lives: dict = field(default_factory=lambda: dict(HALF_LIVES))
    hop_decay: float = 0.5
    min_edge_weight: float = 0.5
    max_expansion: int = 20
    expansion_kept: int = 3
    per_class_neighbors: int = 5
    causal_days: int = 30
    token_budget: int = 3000
    recall_threshold: float = 0.5
    gate_delta: float = 0.05
    coverage_gate: float = 50.0


DEFAULTS = Settings()
