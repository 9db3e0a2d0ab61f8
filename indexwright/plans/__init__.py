"""Whole jobs and report queries built from the operators."""
