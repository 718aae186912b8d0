"""gridlens: live tables and declarative views on Spark.

A view configuration (filter, computed columns, group_by with subtotals,
split_by pivots, 27 named aggregates, sorts, slices) compiles to one
DataFrame plan; keyed / append / capped tables are change logs folded with
aggregate functions; streams reach them through ``foreachBatch``.
"""

from gridlens.config import ViewConfig, normalize_config
from gridlens.plans.view import View, view

__all__ = ["ViewConfig", "normalize_config", "View", "view"]
