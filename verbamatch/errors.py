"""Driver-side exceptions. Failures inside Python workers surface as Spark's PythonException."""

from __future__ import annotations


class MatchError(Exception):
    """Base of everything raised on purpose by this package."""


class PipelineError(MatchError):
    """A preprocessing pipeline can't be built or run."""


class StageProcessingError(PipelineError):
    """A stage failed on its input."""

    def __init__(self, stage_name: str, original_error: Exception):
        super().__init__(f"stage {stage_name!r} failed: {original_error}")
        self.stage_name = stage_name
        self.original_error = original_error


class StageConfigError(PipelineError):
    """A stage was given settings it can't use."""
