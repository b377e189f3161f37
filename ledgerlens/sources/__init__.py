"""Readers, writers, and the adapters that turn the driver's tables into transactions."""
