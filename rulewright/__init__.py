"""Deductive analytics on Spark: typed relations, rules and fixpoints as DataFrame plans."""
