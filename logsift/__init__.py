"""Noise cutting for large tables of captured text output, and accounting of where tokens go."""

from logsift.options import DEFAULTS, Options

__all__ = ["DEFAULTS", "Options"]
