"""Substitution-model ranking for large collections of aligned coding DNA, as Spark jobs."""
