"""Calls to services that fail for a while."""

from __future__ import annotations

import time
from collections.abc import Callable


class Transient(RuntimeError):
    """What a caller's function raises for a failure that may pass: a limit of rate, a lost connection, a timeout."""


def retrying(call: Callable, retries: int = 3, base_delay: float = 1.0, transient: tuple[type[Exception], ...] = (Transient, ConnectionError, TimeoutError), sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``call`` with ``retries`` more attempts, each after twice the delay; other errors, and the last one, go to the caller."""

    def run(*args, **named):
        for attempt in range(retries + 1):
            try:
                return call(*args, **named)
            except transient:
                if attempt == retries:
                    raise
                sleep(base_delay * 2**attempt)

    return run
