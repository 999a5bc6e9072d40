"""Readers of the inputs, and inputs derived from the test tables."""
