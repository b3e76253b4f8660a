"""Joins, candidates, ranks and episode operators over knowledge-graph tables."""
