"""Readers and writers of fact, rule, query, domain, soft-fact and run-log text."""
