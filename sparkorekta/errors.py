"""Errors with a code, whether a retry can help, and what they are about."""

from __future__ import annotations


class KorektaError(Exception):
    """Base of the engine's own errors."""

    code = "error"

    def __init__(self, message: str, code: str | None = None, retryable: bool = False, context: dict[str, str] | None = None):
        super().__init__(message)
        self.code, self.retryable, self.context = code or self.code, retryable, dict(context or {})


class ConfigurationError(KorektaError):
    code = "configuration.invalid"


class RegistrationError(KorektaError):
    code = "registration.invalid"


class SelectionError(KorektaError):
    """A selection of findings can't be applied."""

    code = "correction.selection"


class UnknownFindingError(SelectionError):
    code = "correction.unknown_finding"


class UncorrectableFindingError(SelectionError):
    code = "correction.uncorrectable_finding"


class CorrectionConflictError(SelectionError):
    code = "correction.conflict"


BY_CODE = {e.code: e for e in (UnknownFindingError, UncorrectableFindingError, CorrectionConflictError)}
