"""Quotas that fail a query instead of truncating it."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The messages of the three quotas.
ROWS = "would fetch too many rows"
CHUNK_BYTES = "would fetch too many chunk bytes"
DATA_BYTES = "would fetch too many data bytes"

LimitFunc = Callable[[], int]


class ResourceExhausted(RuntimeError):
    """A quota was used up."""


def is_resource_exhausted(error: BaseException | None) -> bool:
    """Whether the error, or one that caused it, is about a quota."""
    while error is not None:
        if isinstance(error, ResourceExhausted):
            return True
        error = error.__cause__ or error.__context__
    return False


class Quota:
    """Counts down from a limit; 0 means unlimited, a negative reserve gives back."""

    def __init__(self, limit: int):
        self.limit, self._left, self._lock = limit, limit, threading.Lock()

    def reserve(self, n: int) -> None:
        if not self.limit:
            return
        with self._lock:
            if n > self._left:
                raise ResourceExhausted(f"resource exhausted (used {self.limit - self._left + n} of {self.limit})")
            self._left -= n


def reserve_rows(quota: Quota, matched: DataFrame) -> None:
    """Charges the matched rows; counts no further than the limit needs."""
    if quota.limit:
        n = matched.limit(quota.limit + 1).count()
        try:
            quota.reserve(n)
        except ResourceExhausted as e:
            raise ResourceExhausted(ROWS) from e


def reserve_bytes(quota: Quota, df: DataFrame, column: str, message: str) -> None:
    """Charges the sum of a byte column (an estimate of the stored size)."""
    if quota.limit:
        n = df.agg(F.coalesce(F.sum(column), F.lit(0))).first()[0]
        try:
            quota.reserve(int(n))
        except ResourceExhausted as e:
            raise ResourceExhausted(message) from e
