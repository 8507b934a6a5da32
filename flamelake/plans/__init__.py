"""Selectors: from the text a user writes to Spark predicates."""
