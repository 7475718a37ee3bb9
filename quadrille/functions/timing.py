"""How long the steps on the driver take, as log lines."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager

log = logging.getLogger("quadrille")


@contextmanager
def timed(what: str, level: int = logging.INFO) -> Iterator[dict]:
    """Logs a step's seconds when it ends, and that it failed if it did; the dict then holds them, too."""
    took: dict[str, float] = {}
    began = time.perf_counter()
    try:
        yield took
    except BaseException:
        took["s"] = time.perf_counter() - began
        log.log(level, "%s failed after %.3f s", what, took["s"])
        raise
    took["s"] = time.perf_counter() - began
    log.log(level, "%s took %.3f s", what, took["s"])
