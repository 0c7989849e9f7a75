"""Driving syncs: which mode an adapter runs in, what is kept of its state, and how often a source may be asked."""

from __future__ import annotations

import random
import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from gleaner.sources.sinks import SyncState


class SyncAdapter(Protocol):
    """A connector: reads its source into tables or files, and may change its own state as it goes."""

    name: str

    def sync(self, mode: str, state: dict) -> dict[str, int]: ...


@dataclass
class Result:
    """What a sync came to: the mode it ran in, its counts, and the error that ended it, if one did."""

    adapter: str
    mode: str
    counts: dict[str, int] = field(default_factory=dict)
    error: str | None = None


def sync_one(adapter: SyncAdapter, state: SyncState, now_iso: str, mode: str = "incremental") -> Result:
    """Run an adapter; without a time of its last sync it runs in full. Its state is saved only if it ends well."""
    own = state.adapter(adapter.name)
    run = "full" if mode == "incremental" and not own["lastSyncAt"] else mode
    try:
        counts = adapter.sync(run, own)
    except Exception as error:  # one source must not stop the others
        return Result(adapter.name, run, error=str(error))
    state.save(adapter.name, now_iso)
    return Result(adapter.name, run, counts)


def sync_all(adapters: list[SyncAdapter], state: SyncState, now_iso: str, mode: str = "incremental", then: Callable[[Result], None] | None = None) -> list[Result]:
    """Run adapters one after the other; `then`, such as an index update, follows each that ended well."""
    out = []
    for adapter in adapters:
        result = sync_one(adapter, state, now_iso, mode)
        if then is not None and result.error is None:
            try:
                then(result)
            except Exception as error:
                result.error = str(error)
        out.append(result)
    return out


def retry_delay(attempt: int, base: float = 1.0, most: float = 30.0, jitter: Callable[[], float] = random.random) -> float:
    """Seconds to wait before the retry after the given attempt (from 0): doubling up to `most`, and up to a tenth more."""
    wait = min(base * 2**attempt, most)
    return wait * (1 + 0.1 * jitter())


class RateLimit:
    """Spaces requests: a least delay, at most `requests` in a window of seconds, and at most `units` of quota in another."""

    def __init__(self, delay: float = 0.0, requests: int | None = None, window: float = 60.0, units: int | None = None, unit_window: float = 1.0, clock=time.monotonic, sleep=time.sleep):
        self.delay, self.requests, self.window, self.units, self.unit_window = delay, requests, window, units, unit_window
        self.clock, self.sleep = clock, sleep
        self.asked: deque[tuple[float, int]] = deque()
        self.until = 0.0

    def back_off(self, seconds: float) -> None:
        """Hold all requests for some seconds, as a server asked for."""
        self.until = max(self.until, self.clock() + seconds)

    def _wait(self, cost: int) -> float:
        now = self.clock()
        while self.asked and self.asked[0][0] <= now - max(self.window, self.unit_window):
            self.asked.popleft()
        waits = [self.until - now]
        if self.asked:
            waits.append(self.asked[-1][0] + self.delay - now)
        recent = [t for t, _ in self.asked if t > now - self.window]
        if self.requests is not None and len(recent) >= self.requests:
            waits.append(recent[len(recent) - self.requests] + self.window - now)
        if self.units is not None:
            spent = [(t, n) for t, n in self.asked if t > now - self.unit_window]
            over = sum(n for _, n in spent) + cost - self.units
            for t, n in spent:
                if over <= 0:
                    break
                waits.append(t + self.unit_window - now)
                over -= n
        return max(0.0, *waits)

    def acquire(self, cost: int = 1) -> None:
        """Wait until a request of this cost may go."""
        while (wait := self._wait(cost)) > 0:
            self.sleep(wait)
        self.asked.append((self.clock(), cost))
