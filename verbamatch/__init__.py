"""Fuzzy matching, ranked retrieval and record linkage as Spark query plans."""

from .config import MatchConfig
from .errors import MatchError, PipelineError, StageConfigError, StageProcessingError
from .operators.calibration import Calibrator, Report
from .operators.fusion import fuse_lists
from .operators.index import Index, fit_bm25, fit_dense, fit_tfidf, score_bm25, score_dense, score_tfidf, tfidf_weights, top
from .operators.matcher import Matcher
from .sources.frames import spark_frame

__all__ = [
    "Calibrator", "Index", "MatchConfig", "MatchError", "Matcher", "PipelineError", "Report", "StageConfigError", "StageProcessingError",
    "fit_bm25", "fit_dense", "fit_tfidf", "fuse_lists", "score_bm25", "score_dense", "score_tfidf", "spark_frame", "tfidf_weights", "top",
]
