"""Driver-side helpers for fetching: retries with backoff and a sliding-window limit."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable
from typing import TypeVar

R = TypeVar("R")


class RetryAfter(Exception):
    """The source asks to wait."""

    def __init__(self, seconds: float | None = None) -> None:
        super().__init__(f"retry after {seconds}")
        self.seconds = seconds


def with_retry(call: Callable[[], R], attempts: int = 4, base: float = 1.0, longest: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> R:
    """Calls until it works; waits twice as long each time, or as long as the source asks."""
    for i in range(attempts):
        try:
            return call()
        except (RetryAfter, OSError) as e:
            if i == attempts - 1:
                raise
            asked = getattr(e, "seconds", None)
            sleep(min(longest, asked if asked is not None else base * 2**i))
    raise AssertionError


class RateLimiter:
    """At most ``calls`` in any ``period`` seconds."""

    def __init__(self, calls: int, period: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.calls, self.period, self.clock, self.sleep, self.past = calls, period, clock, sleep, deque()

    def acquire(self) -> None:
        now = self.clock()
        while self.past and now - self.past[0] >= self.period:
            self.past.popleft()
        if len(self.past) >= self.calls:
            self.sleep(self.period - (now - self.past[0]))
            return self.acquire()
        self.past.append(self.clock())
        return None
