"""Experiment plans, catalogues, outer folds and predicate policies."""
