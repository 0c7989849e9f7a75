"""Which errors of a connector's requests are worth another try, and calls that are tried again."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a message holds, in lower case, and the statuses that make an error one to retry, by source.
_NETWORK = ("econnreset", "etimedout", "socket hang up")
MESSAGES = {
    "core": (*_NETWORK, "enotfound", "fetch failed"),
    "chat": (*_NETWORK, "enotfound", "fetch failed", "rate limit"),
    "mail": _NETWORK,
    "issues": (*_NETWORK, "fetch failed", "429", "500", "502", "503", "504"),
    "pages": ("rate", "timeout", "econnreset", "503", "502", "429"),
}
SERVER_STATUS = ("core", "chat", "mail")
BUSY_STATUS = ("chat", "mail")
RATE_LIMIT = ("rateLimitExceeded", "429", "Quota exceeded")


def is_retryable(source: str, status: Column, message: Column) -> Column:
    """Whether an error of a source, by its status and message, is transient."""
    said = F.lower(F.coalesce(message, F.lit("")))
    out = reduce(lambda a, b: a | b, [F.contains(said, F.lit(x)) for x in MESSAGES[source]])
    if source in SERVER_STATUS:
        out = out | F.coalesce((status >= 500) & (status < 600), F.lit(False))
    if source in BUSY_STATUS:
        out = out | F.coalesce(status == 429, F.lit(False))
    return out


def is_rate_limit(message: Column) -> Column:
    """Whether the command-line mail reader was told to wait."""
    return reduce(lambda a, b: a | b, [F.contains(F.coalesce(message, F.lit("")), F.lit(x)) for x in RATE_LIMIT])


def is_history_expired(status: Column, message: Column) -> Column:
    """Whether a history feed no longer reaches back, so that all has to be read again."""
    return F.coalesce(status == 404, F.lit(False)) | F.contains(F.coalesce(message, F.lit("")), F.lit("404"))


def retried(call: Callable, tries: int = 3, wait: float = 2.0, transient: tuple[type[BaseException], ...] = (ConnectionError, TimeoutError)):
    """The result of `call`, tried again after connection errors with growing waits; other errors, and the last one, are raised."""
    for n in range(1, tries + 1):
        try:
            return call()
        except transient:
            if n == tries:
                raise
            time.sleep(n * wait)
