"""Settings of a matcher, checked once on the driver."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

ALGORITHMS = ("cosine", "entity", "edit", "phonetic", "semantic")
DEFAULT_WEIGHTS = {"cosine": 0.35, "edit": 0.35, "phonetic": 0.15, "entity": 0.15}
BASIC = {"cosine": 0.5, "edit": 0.5, "phonetic": 0.0}
BASIC_SEMANTIC = {"cosine": 0.3, "edit": 0.3, "phonetic": 0.0, "semantic": 0.4}
SMART = {"cosine": 0.45, "edit": 0.25, "phonetic": 0.20, "entity": 0.10}
SMART_SEMANTIC = {"cosine": 0.30, "edit": 0.15, "phonetic": 0.15, "entity": 0.10, "semantic": 0.30}


def normalised(weights: dict[str, float] | None) -> dict[str, float]:
    """Weights that sum to 1; none at all means the defaults, a zero total is left as it is."""
    weights = dict(weights or DEFAULT_WEIGHTS)
    total = sum(weights.values()) or 1.0
    return {k: v / total for k, v in weights.items()}


@dataclass(frozen=True)
class MatchConfig:
    """How texts are prepared, retrieved, scored and fused.

    `encoder` turns a list of texts into a list of vectors; it is called for some
    hundred texts at a time on the executors (see functions.encoders).  `algorithm` (a callable of two prepared
    texts, or an object with `compare`) replaces the weighted hybrid; rank fusion has no
    rankings then and gives nothing.  `strict` raises on null texts instead of leaving them.
    """

    mode: str = "basic"
    entities: tuple[str, ...] | None = None
    weights: dict[str, float] | None = None
    fusion: str = "linear"
    rrf_k: int = 60
    rrf_weights: dict[str, float] | None = None
    index: str = "tfidf"
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    use_embeddings: bool = False
    encoder: Callable[[list[str]], list] | None = field(default=None, compare=False)
    reuse_dense: bool = True
    lemmatizer: Callable[[list[str]], list[str]] | None = field(default=None, compare=False)
    algorithm: Callable[[str, str], float] | None = field(default=None, compare=False)
    strict: bool = False

    def __post_init__(self):
        for name, value, known in (("mode", self.mode, ("basic", "smart")), ("fusion", self.fusion, ("linear", "rrf")), ("index", self.index, ("tfidf", "bm25", "dense"))):
            if value not in known:
                raise ValueError(f"{name} must be one of {known}, not {value!r}")
        unknown = set(self.weights or ()) - set(ALGORITHMS)
        if unknown:
            raise ValueError(f"unknown algorithms in weights: {sorted(unknown)}")
        if (self.index == "dense" or self.use_embeddings) and self.encoder is None:
            raise ValueError("an encoder is needed for dense retrieval and for semantic scores")

    @property
    def active(self) -> dict[str, float]:
        """Normalised weights of the hybrid score."""
        if self.weights is not None:
            return normalised(self.weights)
        if self.mode == "smart":
            return normalised(SMART_SEMANTIC if self.use_embeddings else SMART)
        return normalised(BASIC_SEMANTIC if self.use_embeddings else BASIC)

    @classmethod
    def basic(cls, **settings) -> MatchConfig:
        return cls(mode="basic", **settings)

    @classmethod
    def smart(cls, **settings) -> MatchConfig:
        return cls(mode="smart", **settings)
