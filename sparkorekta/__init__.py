"""Detection and correction of errors in Polish texts held in DataFrame columns."""

from .config import Options, from_config, from_toml
from .errors import ConfigurationError, CorrectionConflictError, KorektaError, RegistrationError, SelectionError, UncorrectableFindingError, UnknownFindingError
from .operators.detect import analyze, apply_selected, correct, findings, normalize_findings, with_ids
from .operators.morphology import all_findings

__all__ = ["ConfigurationError", "CorrectionConflictError", "KorektaError", "Options", "RegistrationError", "SelectionError", "UncorrectableFindingError", "UnknownFindingError", "all_findings", "analyze", "apply_selected", "correct", "findings", "from_config", "from_toml", "normalize_findings", "with_ids"]
