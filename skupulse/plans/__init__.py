"""Registered queries (one per inventory operator) and their oracle SQL."""

from skupulse.plans import q_clicks, q_demand, q_features, q_forecast, q_misc, q_models, q_network, q_panel, q_plan  # noqa: F401  (registers queries)
from skupulse.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
