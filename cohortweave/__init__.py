"""Cohort analytics on Spark: annotation joins, matrices, phenotypes, scores, metrics and profiles."""
