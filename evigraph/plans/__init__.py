"""Registered queries: Spark plan and equivalent SQL side by side."""
