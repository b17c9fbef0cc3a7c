"""Operators put together into the runs a user starts."""
