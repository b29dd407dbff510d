"""Errors of the engine."""


class KontingentError(Exception):
    """Base of all errors raised on purpose."""


class ValidationError(KontingentError):
    """Input that does not describe a data set or a model."""


class ComputationError(KontingentError):
    """A computation that has no result."""


class ConvergenceError(ComputationError):
    """An iterative fit that did not converge."""

    def __init__(self, message: str, iterations: int = 0, error: float = float("nan")):
        super().__init__(f"{message} (after {iterations} iterations, error {error:g})")
        self.iterations, self.error = iterations, error


class ModelError(KontingentError):
    """A model that cannot be used this way."""


class JunctionTreeError(ModelError):
    """No junction tree exists."""


class SearchError(KontingentError):
    """A search that cannot run."""


class SearchCancelled(SearchError):
    """A search that was told to stop."""
