"""Registered queries and their equivalent SQL."""

CORE_MODULES = ["lumenframe.plans.session_queries", "lumenframe.plans.frame_queries", "lumenframe.plans.text_queries", "lumenframe.plans.store_queries"]
