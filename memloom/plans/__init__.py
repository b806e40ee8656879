"""Queries of the engine over the test tables, by operator."""
