"""Options of an analysis, from code or from a TOML file."""

from __future__ import annotations

import math
import os
import tomllib
from dataclasses import dataclass

from .errors import ConfigurationError
from .sources.io import CATEGORIES

#: Sections of earlier versions, which are refused.
REFUSED = ("llm", "provider", "correction", "rules")


@dataclass(frozen=True)
class Options:
    """categories: None stands for all, an empty tuple for none."""

    categories: tuple[str, ...] | None = None
    minimum_confidence: float = 0.0

    def __post_init__(self):
        if self.categories is not None:
            named = [self.categories] if isinstance(self.categories, str) else list(self.categories)
            if isinstance(self.categories, str) or any(c not in CATEGORIES for c in named):
                raise ConfigurationError(f"categories have to be a list of {', '.join(CATEGORIES)}", "configuration.invalid_value")
            object.__setattr__(self, "categories", tuple(sorted(set(named))))
        sure = self.minimum_confidence
        if isinstance(sure, bool) or not isinstance(sure, int | float) or not math.isfinite(sure) or not 0 <= sure <= 1:
            raise ConfigurationError("minimum_confidence has to be a number from 0 to 1", "configuration.invalid_value")
        object.__setattr__(self, "minimum_confidence", float(sure) + 0.0)

    def arguments(self) -> dict:
        """Keyword arguments of detect.analyze()."""
        return {"categories": None if self.categories is None else list(self.categories), "minimum_confidence": self.minimum_confidence}


def from_toml(path: str | os.PathLike) -> Options:
    """The options in the section [analysis] of a file."""
    about = {"path": os.fspath(path)}
    if not os.path.exists(path):
        raise ConfigurationError("the file does not exist", "configuration.file_not_found", context=about)
    try:
        with open(path, "rb") as f:
            body = tomllib.load(f)
    except (OSError, ValueError) as e:
        raise ConfigurationError("the file is no valid TOML", "configuration.invalid_file", context=about) from e
    for section in REFUSED:
        if section in body:
            raise ConfigurationError(f"the section {section} is not supported", "configuration.unsupported_section", context=about | {"section": section})
    own = body.get("analysis", {})
    if not isinstance(own, dict):
        raise ConfigurationError("analysis has to be a table", "configuration.invalid_file", context=about)
    named = own.get("categories")
    if named is not None and not isinstance(named, list):
        raise ConfigurationError("categories have to be a list", "configuration.invalid_value", context=about)
    return Options(None if named is None else tuple(named), own.get("minimum_confidence", 0.0))


from_config = from_toml
