"""Rate limits and retries for calls to outside services."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from threading import Lock

#: Calls a minute and burst, and retries, first and largest delay, by service.
RATES = {"duckduckgo": (10, 3), "tavily": (30, 5), "brave": (15, 5), "llm": (30, 10), "scraper": (30, 5), "embeddings": (60, 20)}
RETRIES = {"duckduckgo": (2, 5.0, 30.0), "tavily": (3, 2.0, 30.0), "brave": (3, 2.0, 30.0), "llm": (2, 1.0, 15.0), "scraper": (2, 2.0, 20.0), "embeddings": (3, 1.0, 10.0)}
RETRY_STATUS = (429, 500, 502, 503, 504)
RETRY_ERRORS = ("ConnectionError", "Timeout", "ReadTimeout", "ConnectTimeout", "ConnectionResetError", "BrokenPipeError")


class TokenBucket:
    """So many calls a minute, in bursts of a bounded size.  ``clock`` and ``sleep`` can be replaced in tests."""

    def __init__(self, per_minute: float, burst: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.burst, self.level = per_minute / 60, burst, float(burst)
        self.clock, self.sleep, self.at, self.lock = clock, sleep, clock(), Lock()

    def acquire(self, timeout: float = 300.0) -> bool:
        """Take a token, waiting for it; False if that would take longer than ``timeout``."""
        until = self.clock() + timeout
        while True:
            with self.lock:
                now = self.clock()
                self.level, self.at = min(self.burst, self.level + (now - self.at) * self.rate), now
                if self.level >= 1 - 1e-9:
                    self.level -= 1
                    return True
                wait = (1 - self.level) / self.rate if self.rate > 0 else float("inf")
            if now + wait > until:
                return False
            self.sleep(min(wait, 0.5))


def limiter(service: str, **more) -> TokenBucket:
    return TokenBucket(*RATES.get(service, (20, 5)), **more)


@dataclass
class Retry:
    retries: int = 3
    delay: float = 1.0
    longest: float = 60.0
    factor: float = 2.0

    @classmethod
    def of(cls, service: str) -> Retry:
        return cls(*RETRIES[service]) if service in RETRIES else cls()

    @staticmethod
    def worth(error: Exception) -> bool:
        """A status that may pass, or a failed connection."""
        status = getattr(getattr(error, "response", None), "status_code", None)
        return status in RETRY_STATUS if status is not None else type(error).__name__ in RETRY_ERRORS

    def call(self, f: Callable, *args, bucket: TokenBucket | None = None, sleep: Callable[[float], None] = time.sleep):
        """``f(*args)``, again after growing delays (or the one the service asks for) while it is worth it."""
        delay = self.delay
        for turn in range(self.retries + 1):
            if bucket and not bucket.acquire():
                raise TimeoutError("no call was free in time")
            try:
                return f(*args)
            except Exception as e:
                if turn == self.retries or not self.worth(e):
                    raise
                asked = getattr(getattr(e, "response", None), "headers", {}).get("Retry-After", "")
                sleep(min(float(asked) if str(asked).replace(".", "", 1).isdigit() else delay, self.longest))
                delay = min(delay * self.factor, self.longest)
        raise AssertionError
