"""Timing of parts of a run."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager


class Timings:
    """Seconds by name: count, total, least and most."""

    def __init__(self) -> None:
        self.by_name: dict[str, list[float]] = {}

    @contextmanager
    def scope(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.by_name.setdefault(name, []).append(time.perf_counter() - began)

    def report(self) -> dict[str, dict[str, float]]:
        return {k: {"count": len(v), "total": sum(v), "min": min(v), "max": max(v)} for k, v in self.by_name.items()}
