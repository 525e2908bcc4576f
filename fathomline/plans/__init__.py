"""Whole jobs composed from the operators, and their binding to the test tables."""
