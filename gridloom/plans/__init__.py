"""Chains of operators, the registered queries, and their SQL."""
