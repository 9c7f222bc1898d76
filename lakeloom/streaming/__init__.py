"""Refreshing a store from a stream of files."""
