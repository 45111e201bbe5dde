"""Queries of the core."""

from framewright.queries import align, data_problems, evaluation, frames, joins, metrics, simulation, text  # noqa: F401
