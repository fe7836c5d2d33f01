"""Pair counts kept up to date as points arrive."""

from .incremental import IncrementalPairCount

__all__ = ["IncrementalPairCount"]
