"""Queries of the inventory; importing a module registers its queries."""

from loomwork.plans import graph_plans, memory_plans, monitor_plans, relational_plans, text_plans, vector_plans  # noqa: F401
