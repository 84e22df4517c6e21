"""Registered queries of the feature operators and their SQL."""
