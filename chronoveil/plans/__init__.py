"""Registered queries and the SQL they are checked against."""

from chronoveil.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
