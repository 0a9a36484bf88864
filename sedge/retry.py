"""Pluggable remote calls: retries with exponential back-off, and a first-answer-or-fallback rule."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import TypeVar

A = TypeVar("A")


@dataclass(frozen=True)
class Policy:
    """Delays double from ``first_s`` to ``most_s``; ``tries`` calls at most."""

    tries: int
    first_s: float
    most_s: float
    jitter: float = 0.1

    def delays(self, rng: random.Random | None = None) -> Iterator[float]:
        rng = rng or random.Random()
        for i in range(self.tries - 1):
            delay = min(self.first_s * 2**i, self.most_s)
            yield min(self.most_s, delay * rng.uniform(1 - self.jitter, 1 + self.jitter))


# Policies of the remote calls.
SCRAPE, OCR, EMBED, EXTRACT = Policy(6, 0.25, 5), Policy(5, 0.2, 5), Policy(3, 0.2, 5), Policy(2, 0.2, 5)


def call(f: Callable[[], A], policy: Policy, retry_on: type[Exception] | tuple[type[Exception], ...] = OSError, sleep: Callable[[float], None] = time.sleep, rng: random.Random | None = None) -> A:
    """The first result of ``f``; the last error once the tries are used up."""
    for delay in policy.delays(rng):
        try:
            return f()
        except retry_on:
            sleep(delay)
    return f()
