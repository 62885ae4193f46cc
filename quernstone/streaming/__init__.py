"""Results as a stream of Arrow chunks. There are no unbounded sources: every stream here is a finished query's result."""

from .ipc import from_chunks, ipc_round_trip, to_chunks

__all__ = ["from_chunks", "ipc_round_trip", "to_chunks"]
