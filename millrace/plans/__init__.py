"""Bindings of every operator to the test tables."""

from millrace.plans import (  # noqa: F401  (fill the registry)
    aggregate_plans,
    filter_plans,
    function_plans,
    io_plans,
    join_plans,
    learning_plans,
)
from millrace.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
