"""Scans of landed documents and tables, and the sinks of the engine."""
