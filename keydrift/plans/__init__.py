"""Whole runs: comparisons, jobs and data generation."""

from keydrift.plans.comparison import benchmark, compare, read_pair, resolve_modes, strategy_matrix
from keydrift.plans.generator import generate
from keydrift.plans.job import run_job

__all__ = [
    "benchmark",
    "compare",
    "generate",
    "read_pair",
    "resolve_modes",
    "run_job",
    "strategy_matrix",
]
