"""Imports every query module so the registry is complete."""

from . import registry
from . import q_eval, q_infer, q_more, q_shape, q_stats, q_text  # noqa: F401

QUERIES = registry.QUERIES
ORACLE = registry.ORACLE
