"""Keyed snapshot comparison on Spark DataFrames.

The public surface: build a :class:`DiffOptions`, then call one of the lazy
diffs in :mod:`keydrift.operators`, or the eager :func:`keydrift.plans.compare`
that writes the result.
"""

from keydrift.options import DiffOptions, GeneratorOptions

__all__ = ["DiffOptions", "GeneratorOptions"]
