"""Readers: transaction and account CSV files, stored graphs, and graphs derived from the driver's tables."""
