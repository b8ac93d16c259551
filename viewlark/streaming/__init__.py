"""Liveness: dependencies, dirty marks and ticks on the driver; micro-batches in Structured Streaming."""

from .live import DependencyGraph, DirtyTracker, TickCoordinator
from .micro_batches import StreamedTable, stream

__all__ = ["DependencyGraph", "DirtyTracker", "StreamedTable", "TickCoordinator", "stream"]
