"""Stamps of running streams, and a watch over them that fires once."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Collection
from dataclasses import dataclass

from pyspark.sql.streaming import StreamingQueryListener

from tidemark.functions.scalars import ALIVE_SECONDS, STALL_SECONDS


class Health(StreamingQueryListener):
    """When streams last moved rows or had caught up (progress), when each last gave a sign of life, and how many rows came too late.

    `pushes` and `watchers` name the queries whose progress and life count; None means every query. A stream that ends with an error
    fences, as `fence` does. Rows that a stateful operator drops behind its watermark are added up as the operator counts
    them, which for aggregates is after rows of one key and batch were merged.
    """

    def __init__(self, pushes: Collection[str] | None = None, watchers: Collection[str] | None = None, clock: Callable[[], float] = time.monotonic):
        self.pushes, self.watchers, self.clock = pushes, watchers, clock
        self.progress, self.alive, self.names = clock(), {}, {}
        self.fenced, self.late, self.ended, self.lock = False, 0, set(), threading.Lock()

    def fence(self) -> None:
        self.fenced = True

    def _stamp(self, run: str, moved: bool) -> None:
        name = self.names.get(run)
        if self.watchers is None or name in self.watchers:
            self.alive[run] = self.clock()
        if moved and (self.pushes is None or name in self.pushes):
            self.progress = self.clock()

    def onQueryStarted(self, event) -> None:
        with self.lock:
            self.names[str(event.runId)] = event.name

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self.lock:
            self._stamp(str(p.runId), p.numInputRows > 0)
            self.late += sum(o.numRowsDroppedByWatermark for o in p.stateOperators)

    def onQueryIdle(self, event) -> None:
        with self.lock:
            self._stamp(str(event.runId), True)

    def onQueryTerminated(self, event) -> None:
        run = str(event.runId)
        with self.lock:
            self.alive.pop(run, None)
            self.fenced |= event.exception is not None and (self.watchers is None or self.names.get(run) in self.watchers)
            self.ended.add(run)

    def idle(self) -> int:
        return int(self.clock() - self.progress)

    def silent(self) -> int:
        """Seconds since the last sign of the stream that is silent longest; 0 before the first."""
        with self.lock:
            return int(self.clock() - min(self.alive.values())) if self.alive else 0


@dataclass(frozen=True)
class Stall:
    trigger: str
    pending: int
    idle: int
    restarts: bool


def trigger(pending: int, idle: int, fenced: bool, silent: int, threshold: int = STALL_SECONDS, alive_threshold: int = ALIVE_SECONDS) -> str | None:
    """As `scalars.recovery_trigger`, for one state."""
    if pending > 0 and idle >= threshold:
        return "push_stall"
    return "watcher_fenced" if fenced else "watcher_stale" if silent >= alive_threshold else None


class Watchdog:
    """Looks every `tick` seconds, first after one of them; calls `on_stall` at the first trigger and ends. `pending` that fails counts as one."""

    def __init__(self, health: Health, pending: Callable[[], int], on_stall: Callable[[Stall], None], tick: float = 60.0, threshold: int = STALL_SECONDS, alive_threshold: int = ALIVE_SECONDS, disabled: bool = False):
        self.health, self.pending, self.on_stall, self.tick = health, pending, on_stall, tick
        self.limits, self.disabled, self.stopped = (threshold, alive_threshold), disabled, threading.Event()
        self.thread = threading.Thread(target=self._run, name="watchdog", daemon=True)

    def start(self) -> Watchdog:
        self.thread.start()
        return self

    def stop(self) -> None:
        self.stopped.set()
        self.thread.join()

    def look(self) -> Stall | None:
        try:
            pending = self.pending()
        except Exception:  # noqa: BLE001
            pending = 1
        idle = self.health.idle()
        found = trigger(pending, idle, self.health.fenced, self.health.silent(), *self.limits)
        return Stall(found, pending, idle, not self.disabled) if found else None

    def _run(self) -> None:
        while not self.stopped.wait(self.tick):
            if found := self.look():
                self.on_stall(found)
                return
