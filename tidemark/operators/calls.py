"""Remote calls from a task: a bounded queue with retries, growing waits and a rate limit; what stays unanswered keeps its error."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass


@dataclass(frozen=True)
class Policy:
    """How a task calls: *threads* at once, *tries* for each row, *wait* seconds before the second try and twice as long before
    each further one (*most* at most), *rate* calls a second (None: no limit)."""

    threads: int = 5
    tries: int = 3
    wait: float = 0.5
    most: float = 30.0
    rate: float | None = None


class Pace:
    """Spreads calls of all threads: one for each 1 / rate seconds."""

    def __init__(self, rate: float | None):
        self.gap, self.next, self.lock = 1 / rate if rate else 0.0, 0.0, threading.Lock()

    def take(self) -> None:
        if not self.gap:
            return
        with self.lock:
            now = time.monotonic()
            at, self.next = max(now, self.next), max(now, self.next) + self.gap
        time.sleep(max(0.0, at - now))


def called(client: Callable[..., str], row: tuple, policy: Policy, pace: Pace) -> tuple[str | None, str | None]:
    """(answer, None), or (None, the last error). An error with a false attribute *retry* is final."""
    error = ""
    for i in range(max(1, policy.tries)):
        if i:
            time.sleep(min(policy.most, policy.wait * 2 ** (i - 1)))
        pace.take()
        try:
            return client(*row), None
        except Exception as e:  # noqa: BLE001  a failed call is a row with an error
            error = str(e) or type(e).__name__
            if not getattr(e, "retry", True):
                break
    return None, error


def answers(client: Callable[..., str], rows: Iterable[tuple], policy: Policy) -> Iterator[tuple[str | None, str | None]]:
    """The rows' answers in their order; at most two rows for each thread are waiting or under way."""
    pace, open_ = Pace(policy.rate), deque()
    with ThreadPoolExecutor(policy.threads) as pool:
        for row in rows:
            open_.append(pool.submit(called, client, row, policy, pace))
            if len(open_) >= 2 * policy.threads:
                yield open_.popleft().result()
        while open_:
            yield open_.popleft().result()
