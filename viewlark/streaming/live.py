"""Who depends on which table, and when they are told."""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable
from concurrent.futures import Executor

from ..tables import Table

Run = Callable[[], None]


class Registration:
    def __init__(self, undo: Run):
        self._undo, self._open = undo, True

    def close(self) -> None:
        if self._open:
            self._open = False
            self._undo()

    def __enter__(self) -> Registration:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


class DependencyGraph:
    """From tables (by identity) to what is to be run when they change; the same callable counts once a table."""

    def __init__(self) -> None:
        self._lock, self._runs = threading.RLock(), {}

    def register(self, source: Table, on_dirty: Run) -> Registration:
        with self._lock:
            own = self._runs.setdefault(id(source), (source, []))[1]
            if on_dirty not in own:
                own.append(on_dirty)
        return Registration(lambda: self._remove(source, on_dirty))

    def _remove(self, source: Table, on_dirty: Run) -> None:
        with self._lock:
            _, own = self._runs.get(id(source), (source, []))
            if on_dirty in own:
                own.remove(on_dirty)
            if not own:
                self._runs.pop(id(source), None)

    def fire(self, source: Table) -> None:
        with self._lock:
            own = list(self._runs.get(id(source), (source, []))[1])
        for run in own:
            run()


class DirtyTracker:
    def __init__(self, graph: DependencyGraph | None = None):
        self.graph = graph or DependencyGraph()

    def watch(self, source: Table, on_dirty: Run) -> Registration:
        return self.graph.register(source, on_dirty)

    def mark_dirty(self, source: Table) -> None:
        self.graph.fire(source)


class TickCoordinator:
    """A bounded queue of work that is drained in batches; what does not fit is refused with an error."""

    CAPACITY = 8192

    def __init__(self, capacity: int = CAPACITY):
        self._queue: queue.Queue[Run] = queue.Queue(capacity)
        self._timer: threading.Timer | None = None
        self._closed = False

    def enqueue(self, work: Run) -> None:
        if self._closed:
            raise RuntimeError("the coordinator is closed")
        try:
            self._queue.put_nowait(work)
        except queue.Full:
            raise OverflowError(f"backlog is full: {self._queue.maxsize}") from None

    def drain_blocking(self, limit: int | None = None) -> int:
        """Run what is queued, on this thread; returns how many ran."""
        done = 0
        while limit is None or done < limit:
            try:
                work = self._queue.get_nowait()
            except queue.Empty:
                break
            work()
            done += 1
        return done

    def drain_async_on(self, executor: Executor):  # noqa: ANN201
        return executor.submit(self.drain_blocking)

    def schedule_drain(self, period_seconds: float, executor: Executor | None = None) -> Registration:
        def tick() -> None:
            if self._closed:
                return
            self.drain_async_on(executor) if executor else self.drain_blocking()
            self._timer = threading.Timer(period_seconds, tick)
            self._timer.daemon = True
            self._timer.start()

        self._timer = threading.Timer(period_seconds, tick)
        self._timer.daemon = True
        self._timer.start()
        return Registration(self._stop)

    def _stop(self) -> None:
        if self._timer:
            self._timer.cancel()

    @property
    def approximate_backlog(self) -> int:
        return self._queue.qsize()

    def close(self) -> None:
        self._closed = True
        self._stop()
