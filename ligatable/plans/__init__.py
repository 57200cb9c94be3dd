"""Whole jobs, the query catalogue and its SQL twins."""
