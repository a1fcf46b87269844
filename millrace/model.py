"""Record schema and the constants of ranking and hygiene."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values.
TYPES = ("memory", "skill", "session", "daily", "person", "project", "decision", "distillation")
CONFIDENCES = ("extracted", "inferred", "ambiguous")
AUTHORED_TYPES = ("memory", "skill", "daily")
TYPE_BIAS = {"distillation": 1.10, "memory": 1.05, "skill": 1.05, "project": 1.05, "decision": 1.05, "person": 1.0, "daily": 1.0, "session": 0.85}
SEED_WEIGHTS = {"skill": 0.7, "decision": 0.6, "distillation": 0.7, "memory": 0.5, "project": 0.5, "person": 0.5, "daily": 0.4, "session": 0.3}
NEUTRAL_IMPORTANCE = 0.5
TRANSIENT_DAYS = 28
SKILL_REQUIRED = ("title", "scope", "verification")
ID_NAMESPACE = "a3c1f0de-1b2c-4d3e-9f80-0a1b2c3d4e5f"

RECORD = (
    "id string, type string, created timestamp, updated timestamp, source string, title string, body string, "
    "tags array<string>, links array<string>, importance double, valid_from timestamp, valid_to timestamp, "
    "deprecated_by string, deleted_at timestamp, scope string, verification string, confidence string, "
    "provenance struct<source:string,ref:string,ingested_at:timestamp>, path string, extras map<string,string>"
)
#: What a source emits: a parsed file or transcript before it becomes a record.
SOURCE_RECORD = "source string, ref string, title string, body string, tags array<string>, metadata map<string,string>"


@dataclass(frozen=True)
class SearchOptions:
    """Options of a hybrid search. Empty or non-positive values switch a feature off."""

    limit: int = 10
    types: tuple[str, ...] = ()
    rrf_k: int = 60
    bm25_weight: float = 1.0
    vector_weight: float = 1.0
    importance_weight: float = 0.2
    type_bias: dict[str, float] = field(default_factory=lambda: dict(TYPE_BIAS))
    include_expired: bool = False
    include_deprecated: bool = False
    include_deleted: bool = False
    mmr_lambda: float | None = None
    rerank_top_n: int = 0
    over_fetch: int = 5

    @property
    def candidates(self) -> int:
        """Hits that each of the two retrievals returns."""
        return self.limit * self.over_fetch

    @property
    def materialised(self) -> int:
        """Hits that are re-scored and kept for reranking and diversification."""
        wide = self.over_fetch * self.limit if self.mmr_lambda is not None else 0
        return max(self.limit, wide, self.rerank_top_n)


def clamp_limit(limit: int) -> int:
    return min(100, max(1, limit))


def clamp_rerank(n: int) -> int:
    return min(50, max(1, n))
