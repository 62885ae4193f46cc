"""Relational operators that ask for more than one DataFrame call."""

from .aggregate import two_phase
from .exchange import broadcast_side, coalesce_exchange, colocated, hash_exchange, merge_exchange, round_robin_exchange
from .join import block_join

__all__ = ["block_join", "broadcast_side", "coalesce_exchange", "colocated", "hash_exchange", "merge_exchange", "round_robin_exchange", "two_phase"]
