"""Term lists, weights and limits of retrieval and answering. Defaults are fixed values; every job takes a Config."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values, as text: changing them changes results.
RISK_TERMS = ("risk", "hazard", "danger", "failure", "consequence", "safety", "accident", "injury", "fire", "emergency")
PROCEDURE_TERMS = ("procedure", "sequence", "step", "start", "stop", "inspection", "checklist", "execute", "execution", "operation", "readiness")
OPERATIONAL_TERMS = (
    "belt", "drift", "misalignment", "fire", "hazard", "risk", "danger", "early", "signs", "transfer", "point", "conveyor",
    "grizzly", "hopper", "track", "arch", "formation", "coal", "flow", "wagon", "boiler", "bunker", "safety", "device",
    "pull", "cord", "idler", "pulley", "chute", "blockage", "spillage", "feeder", "observe", "trainee",
    "खतरा", "आग", "क्यों", "होता", "क्या",
)
GENERIC_PHRASES = (
    "you are l1-ready", "you are l1 ready", "what you will learn", "course", "course complete", "assessment", "quick reference",
    "limits", "scoring guide", "self-declaration", "completion declaration", "your role as a trainee", "how to use this course",
)
RELATION_WEIGHTS = {"depends_on": 0.9, "has_control_point": 0.85, "has_task": 0.75, "has_skill": 0.65, "has_swo": 0.6, "has_pwo": 0.55}


@dataclass(frozen=True)
class Phrase:
    """Terms that, all in both query and item, raise the evidence score; lexical only if the candidate score rises too."""

    terms: tuple[str, ...]
    boost: float
    lexical: bool = False


@dataclass(frozen=True)
class Config:
    risk_terms: tuple[str, ...] = RISK_TERMS
    procedure_terms: tuple[str, ...] = PROCEDURE_TERMS
    operational_terms: tuple[str, ...] = OPERATIONAL_TERMS
    generic_phrases: tuple[str, ...] = GENERIC_PHRASES
    phrases: tuple[Phrase, ...] = (Phrase(("belt", "drift"), 0.3, True), Phrase(("fire", "risk"), 0.18))
    relation_weights: dict[str, float] = field(default_factory=lambda: dict(RELATION_WEIGHTS))
    text_top_k: int = 5
    image_top_k: int = 3
    node_top_k: int = 5
    lexical_limit: int = 20
    max_hops: int = 2
    relation_limit: int = 30
    max_context_text: int = 8
    max_context_images: int = 3
    max_context_relations: int = 10
    seed_limit: int = 3
    seed_min_score: float = 0.85
    use_type_boost: bool = False
    disable_graph: bool = False
    debug_full_context: bool = False
    compact_text: int = 5
    compact_images: int = 2
    compact_relations: int = 6
