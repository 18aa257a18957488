"""skupulse: retail demand analytics as Spark DataFrame operators.

Subpackages
-----------
sources    fixture binding and loaders (orders, clicks, users, network, ...)
functions  column expressions (cleaning, guarded ratios, calendar parts)
operators  DataFrame -> DataFrame operators (funnel, panels, features,
           evaluation, network parameters, models, plan checks)
plans      the registered queries and their DuckDB oracle SQL
streaming  incremental variants of the click aggregates
"""

from skupulse.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
