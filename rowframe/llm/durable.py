"""Cutting lineage by files that outlive executors."""

from rowframe.durable import durable

__all__ = ["durable"]
