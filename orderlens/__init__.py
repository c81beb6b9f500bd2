"""Order analytics on Spark.

Cleaning operators, data-quality measures and ten parameterised order
analyses, all written as DataFrame / SQL expressions so that Catalyst plans
them and the work runs distributed.  Every function takes DataFrames plus
column names, so the same code serves any order-shaped schema.
"""

from orderlens.session import build_session, ensure_checkpoint_dir, recommended_conf

__all__ = ["build_session", "ensure_checkpoint_dir", "recommended_conf"]
