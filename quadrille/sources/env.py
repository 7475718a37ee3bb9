"""Reader options in layers, and which errors count as missing data."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

#: Errors that count as missing data by default.
MISSING = (OSError("HTTP response code: 404"),)


@dataclass(frozen=True)
class LayeredOptions:
    """Options for all calls, and more for opening, for opening a warped view, and for reading."""

    always: Mapping = field(default_factory=dict)
    open: Mapping = field(default_factory=dict)
    open_vrt: Mapping = field(default_factory=dict)
    read: Mapping = field(default_factory=dict)

    def for_open(self) -> dict:
        return {**self.always, **self.open}

    def for_open_vrt(self) -> dict:
        """Without options of its own, a warped view opens like any other."""
        return {**self.always, **(self.open_vrt or self.open)}

    def for_read(self) -> dict:
        return {**self.always, **self.read}

    def updated(self, always: Mapping = {}, open: Mapping = {}, open_vrt: Mapping = {}, read: Mapping = {}) -> LayeredOptions:
        return LayeredOptions({**self.always, **always}, {**self.open, **open}, {**self.open_vrt, **open_vrt}, {**self.read, **read})


def matches(error: BaseException, patterns: Iterable[BaseException]) -> bool:
    """Whether an error is of a pattern's class and its message begins as the pattern's, a regular expression, says."""
    return any(isinstance(error, type(p)) and re.match(str(p), str(error)) for p in patterns)


def tolerated(error: Exception, patterns: Iterable[BaseException], url: str, doing: str) -> None:
    """Warns of an error that counts as missing data and raises any other."""
    if not matches(error, patterns):
        raise RuntimeError(f"Error {doing} {url!r}: {error!r}") from error
    warnings.warn(f"Skipping {url!r} after an error {doing} it: {error!r}", stacklevel=2)
