"""Whole queries: the engine's entry points, and the registered queries with their SQL."""
