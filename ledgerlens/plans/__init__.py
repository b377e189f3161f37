"""Whole plans: the feature build, and the registered queries with their SQL."""
