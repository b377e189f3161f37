"""Operators over transactions: history features, statistics, profiles, splits, models and metrics."""
