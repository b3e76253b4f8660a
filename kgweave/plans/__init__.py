"""Fixpoint plans: rule programs, closures and proof search."""
