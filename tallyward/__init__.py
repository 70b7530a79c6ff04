"""Tallyward: data-integrity checks, fault injection and detection scoring as Spark jobs."""

__version__ = "0.1.0"
