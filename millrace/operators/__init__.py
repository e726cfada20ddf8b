"""Operators as compositions of DataFrame operations."""
