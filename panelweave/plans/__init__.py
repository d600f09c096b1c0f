"""Composed plans: the silver and gold tables, and the registered queries with their SQL."""
