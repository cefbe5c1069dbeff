"""Algebra operators as DataFrame operations."""
