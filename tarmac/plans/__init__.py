"""Registered named queries (DataFrame plans) and their oracle SQL."""

from tarmac.plans.registry import ORACLE, QUERIES, load_all  # noqa: F401
