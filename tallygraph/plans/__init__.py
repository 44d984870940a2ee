"""Composed plans: the query roster, reports and the transfer experiment."""
